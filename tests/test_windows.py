import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import READ_SCHEMA, plan_of, query_bases, read, walk_pairs, walk_windows
from pyspark.sql import functions as F

from readwindows import Params
from readwindows.functions import cigar, cigar_batch
from readwindows.operators import align, reads as read_ops, windows

HAND = ["49M", "50M", "100M", "5S50M", "20M1I30M", "20M1D30M", "10H50M", "50=", "20M100N40M", "*", "120M", "3P60M"]


def table(spark, cigars, contig="chr1"):
    rng = random.Random(5)
    rows = [
        read(i, c, "".join(rng.choices("ACGT", k=query_bases(c))) or None, start=1000 + i, contig=contig)
        for i, c in enumerate(cigars)
    ]
    return spark.createDataFrame(rows, READ_SCHEMA), rows


def slid(df, size, step):
    found = {}
    for w in windows.slide(df, size, step).collect():
        found.setdefault(w.read_ordinal, []).append(w)
    return {k: sorted(v, key=lambda w: w.window_index) for k, v in found.items()}


@pytest.mark.parametrize("size,step", [(50, 50), (50, 20), (20, 50)])
def test_hand_cigars(spark, size, step):
    df, rows = table(spark, HAND)
    found = slid(df, size, step)
    for ordinal, row in enumerate(rows):
        expected = walk_windows(row[5], row[3], size, step)
        got = found.get(ordinal, [])
        assert [(w.reference_start, w.reference_end, w.query_start, w.query_end) for w in got] == expected, row[5]
        assert all(w.query_subseq == row[6][w.query_start : w.query_end] for w in got)


def test_random_cigars_equal_a_pair_walker(spark):
    rng = random.Random(11)
    cigars = [
        "".join(f"{rng.randint(1, 40)}{rng.choice('MMMM=XIDNSHP')}" for _ in range(rng.randint(1, 120)))
        for _ in range(300)
    ]
    df, rows = table(spark, cigars)
    found = slid(df, 25, 10)
    total = 0
    for ordinal, row in enumerate(rows):
        expected = walk_windows(row[5], row[3], 25, 10)
        total += len(expected)
        got = [(w.reference_start, w.reference_end, w.query_start, w.query_end) for w in found.get(ordinal, [])]
        assert got == expected
    assert total > 1000
    pairs = {}
    for p in align.pairs(df.where("read_ordinal < 40")).collect():
        pairs.setdefault(p.read_ordinal, []).append((p.pair_index, p.query_pos, p.ref_pos))
    for ordinal in range(40):
        expected = [(i, q, r) for i, (q, r) in enumerate(walk_pairs(rows[ordinal][5], rows[ordinal][3]))]
        assert sorted(pairs.get(ordinal, [])) == expected


def test_batches_equal_the_form_by_rows(spark):
    rng = random.Random(12)
    cigars = ["", "*", None, "M", "5", "12", "M5", "0M", "0M5M0M", "5M0M", "3Z4M", "4M3Z2M", "1M" * 70, *HAND]
    cigars += ["".join(f"{rng.randint(0, 12)}{rng.choice('MM=XIDNSHP')}" for _ in range(rng.randint(1, 40))) for _ in range(200)]
    df = spark.createDataFrame([(c, 100 * i) for i, c in enumerate(cigars)], "c string, s int")
    for size, step in ((1, 1), (5, 3), (3, 7), (50, 50)):
        made = df.select("c", *[f.alias(n) for n, f in (("a", cigar.windows(F.col("c"), F.col("s"), size, step)), ("b", cigar_batch.windows(F.col("c"), F.col("s"), size, step)))])
        assert all((r.a or []) == r.b for r in made.collect())
    made = df.select(cigar.blocks(F.col("c"), F.col("s")).alias("a"), cigar_batch.blocks(F.col("c"), F.col("s")).alias("b"))
    assert all((r.a or []) == r.b for r in made.collect())
    assert cigar_batch.ragged_blocks(pa.array(cigars, pa.string())[5:9], np.zeros(4, np.int64))[4].tolist() == [0, 0, 0, 1, 4]


def test_many_operations_stay_linear(spark):
    cigar = "7M1I3M1D" * 4000
    df, rows = table(spark, [cigar])
    assert align.blocks(df).count() == 8000
    got = windows.slide(df, 10, 10).count()
    assert got == len(walk_windows(cigar, rows[0][3], 10, 10))


def test_rejected_windows_do_not_move_the_grid(spark):
    df, _ = table(spark, ["60M5D100M"])
    assert [w.window_index for w in slid(df, 50, 50)[0]] == [0, 2]


def test_eligible(spark):
    params = Params(window_size=10)
    good = "ACGTACGTAC"
    rows = [
        read(0, "10M", good),
        read(1, "10M", good, mapq=20),
        read(2, "10M", good, mapq=19),
        read(3, "10M", good[:9]),
        read(4, "10M", good, contig="chr2"),
        read(5, "10M", None),
        read(6, "*", good, contig=None, start=-1),
        read(7, "10M", good, flag=16 | 256),
    ]
    df = spark.createDataFrame(rows, READ_SCHEMA)
    assert {r.read_ordinal for r in read_ops.eligible(df, params).collect()} == {0, 1, 7}
    none = spark.createDataFrame([read(8, "4M", "None")], READ_SCHEMA)
    assert read_ops.eligible(none, Params(window_size=2)).count() == 0


def test_summary(spark):
    df = spark.createDataFrame([read(0, "5S20M3I10D30M2H", "A" * 58, flag=16)], READ_SCHEMA)
    row = read_ops.summary(df).first()
    assert (row.reference_length, row.reference_end, row.is_reverse, row.chromosome) == (60, 160, True, "chr1")


def test_windows_need_no_shuffle_and_push_filters(spark, tmp_path):
    df, _ = table(spark, HAND)
    df.write.parquet(str(tmp_path / "reads"))
    scan = spark.read.parquet(str(tmp_path / "reads"))
    plan = plan_of(windows.slide(read_ops.eligible(scan, Params(window_size=50, step_size=50)), 50, 50))
    assert "Exchange" not in plan
    # Only CIGAR and start go to Python.
    (python,) = [line for line in plan.split("\n") if "Arguments: [_windows(" in line]
    assert "query_sequence" not in python
    assert "EqualTo(reference_name,chr1)" in plan and "GreaterThanOrEqual(mapping_quality,20)" in plan
    assert "flag" not in plan.split("ReadSchema")[1]


def test_empty_input(spark):
    empty = spark.createDataFrame([], READ_SCHEMA)
    assert windows.slide(empty, 50, 50).count() == 0
    assert windows.slide(empty, 50, 50).select(F.col("query_subseq")).schema[0].dataType.simpleString() == "string"
