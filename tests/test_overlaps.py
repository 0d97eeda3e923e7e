import random

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from readwindows.operators import intervals, labels

WINDOWS = (
    "source_file string, read_ordinal bigint, window_index bigint, chromosome string, "
    "reference_start bigint, reference_end bigint"
)
PEAKS = "chrom string, start bigint, `end` bigint"


def make(spark, windows, peaks):
    rows = [("f", i, 0, *w) for i, w in enumerate(windows)]
    return spark.createDataFrame(rows, WINDOWS), spark.createDataFrame(peaks, PEAKS)


def brute(windows, peaks, mode, min_overlap):
    out = {}
    for i, (c, s, e) in enumerate(windows):
        hits = sorted(
            (ps, pe, min(e, pe) - max(s, ps)) for pc, ps, pe in peaks if pc == c and ps < e and pe > s and pe > ps
        )
        bp = 0
        if hits:
            bp = max(h[2] for h in hits) if mode == "max" else hits[0][2]
        out[i] = (bp, int(bp >= min_overlap))
    return out


def got(df):
    return {r.read_ordinal: (r.overlap_bp, r.labels) for r in df.collect()}


HAND_WINDOWS = [("chr1", 1000, 1050), ("chr1", 0, 50), ("chr2", 1000, 1050), ("chr1", 5000, 5050), ("chr1", 8000, 8050)]
HAND_PEAKS = [
    ("chr1", 1026, 1400),  # 24 bp
    ("chr1", 50, 90),  # touches
    ("chr1", 4000, 7000),  # contains, spans many cells
    ("chr1", 8000, 8020),  # two of 20 bp each: their sum must not count
    ("chr1", 8030, 8050),
    ("chr1", 8045, 8045),  # empty
]


@pytest.mark.parametrize("mode", labels.MODES)
@pytest.mark.parametrize("bp", [24, 25])
def test_hand_cases(spark, mode, bp):
    windows, peaks = make(spark, HAND_WINDOWS, HAND_PEAKS)
    found = got(labels.by_overlap(windows, peaks, bp, mode, window_size=50))
    assert found == brute(HAND_WINDOWS, HAND_PEAKS, mode, bp)
    assert found[0] == (24, int(bp == 24)) and found[1] == (0, 0) and found[2] == (0, 0) and found[4] == (20, 0)


def random_case(seed, windows=400, peaks=300, size=50, span=6000):
    rng = random.Random(seed)
    ws = [(f"chr{rng.randint(1, 2)}", s, s + size) for s in (rng.randint(0, span) for _ in range(windows))]
    ps = [
        (f"chr{rng.randint(1, 3)}", s, s + int(rng.paretovariate(0.7) * 10) % 3000 + 1)
        for s in (rng.randint(0, span) for _ in range(peaks))
    ]
    # A third of everything at one place.
    ws += [("chr1", 500 + i % 7, 550 + i % 7) for i in range(windows // 2)]
    ps += [("chr1", 480 + i % 90, 530 + i % 31 + i % 90) for i in range(peaks // 2)]
    return ws, ps


@pytest.mark.parametrize("mode", labels.MODES)
@pytest.mark.parametrize("broadcast", [True, False])
def test_random_labels(spark, mode, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(labels, "BROADCAST_ENTRIES", 0)
    ws, ps = random_case(3)
    windows, peaks = make(spark, ws, ps)
    for size in (50, None):
        assert got(labels.by_overlap(windows, peaks, 25, mode, window_size=size)) == brute(ws, ps, mode, 25)


@pytest.mark.parametrize("mode", labels.MODES)
@pytest.mark.parametrize("broadcast", [True, False])
def test_sparse_peaks_are_listed_less_often(spark, mode, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(labels, "BROADCAST_ENTRIES", 0)
    rng = random.Random(5)
    ps = [("chr1", s, s + rng.randint(40, 340)) for s in (rng.randint(0, 300_000) for _ in range(200))]
    ws = [("chr1", s, s + 50) for s in (rng.choice(ps)[1] + rng.randint(-100, 300) for _ in range(300)) if s >= 0]
    windows, peaks = make(spark, ws, ps)
    plain, wide = intervals.choose_cells(peaks, 50), intervals.choose_cells(peaks, 50, wider=labels.WIDER)
    assert wide.width == 8 * plain.width and wide.listed < 0.65 * plain.listed
    assert got(labels.by_overlap(windows, peaks, 25, mode, window_size=50)) == brute(ws, ps, mode, 25)
    crowded = peaks.selectExpr("*", "explode(sequence(1, 20)) AS again").drop("again")
    assert intervals.choose_cells(crowded, 50, wider=labels.WIDER).width == plain.width


def test_lists_per_cell_are_bounded(spark):
    cells = intervals.Cells(width=64, listed=0)
    peaks = spark.range(100_000).select(
        F.lit("chr1").alias("chrom"),
        (1000 + F.col("id") % 113).alias("start"),
        (1200 + F.col("id") % 997).alias("end"),
    )
    for mode in labels.MODES:
        longest = labels._peaks_per_cell(peaks, cells, mode).agg(F.max(F.size("peaks"))).first()[0]
        assert longest <= 2 * cells.width + 1


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_overlap_join(spark, how, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", 0)
    ws, ps = random_case(7, 150, 120)
    windows, peaks = make(spark, ws, ps)
    for least in (1, 25):
        pairs = sorted(
            (r.read_ordinal, r.start or -1, r.end or -1, r.overlap_bp)
            for r in intervals.overlap_join(windows, peaks, how, least).collect()
        )
        expected = []
        for i, (c, s, e) in enumerate(ws):
            hits = [
                (i, ps_, pe, min(e, pe) - max(s, ps_))
                for pc, ps_, pe in ps
                if pc == c and ps_ < e and pe > s and min(e, pe) - max(s, ps_) >= least
            ]
            expected += hits or ([(i, -1, -1, 0)] if how == "left" else [])
        assert pairs == sorted(expected)


def test_no_peaks(spark):
    windows, peaks = make(spark, HAND_WINDOWS, [])
    assert set(got(labels.by_overlap(windows, peaks, 1, window_size=50)).values()) == {(0, 0)}
    assert intervals.overlap_join(windows, peaks, left_width=50).count() == 0


def test_too_wide_window_is_an_error(spark):
    windows, peaks = make(spark, [("chr1", 0, 500)], [("chr1", 10, 20)])
    with pytest.raises(Exception, match="wider than the cell"):
        labels.by_overlap(windows, peaks, 1, window_size=50).collect()


def test_bad_arguments(spark):
    windows, peaks = make(spark, HAND_WINDOWS, HAND_PEAKS)
    with pytest.raises(ValueError):
        labels.by_overlap(windows, peaks, 1, "sum")
    with pytest.raises(ValueError):
        intervals.overlap_join(windows, peaks, "outer")


def test_plans_are_equi_joins(spark, monkeypatch):
    windows, peaks = make(spark, HAND_WINDOWS, HAND_PEAKS)
    for limit in (10**6, 0):
        monkeypatch.setattr(labels, "BROADCAST_ENTRIES", limit)
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", limit)
        for df in (
            labels.by_overlap(windows, peaks, 25, window_size=50),
            intervals.overlap_join(windows, peaks, left_width=50),
        ):
            plan = plan_of(df)
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            assert "HashJoin" in plan or "SortMergeJoin" in plan


def test_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "source_file string, labels int")
    assert sorted(map(tuple, labels.counts(df).collect())) == [("a", 1, 1), ("b", 0, 1)]
    assert tuple(labels.counts(df, by=None).first()) == (1, 2)


def test_hot_cell_is_split_when_peaks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(labels, "BROADCAST_ENTRIES", 0)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    n = 60_000
    start = F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") * 40)
    windows = spark.range(n, numPartitions=8).select(
        F.lit("f").alias("source_file"),
        F.col("id").alias("read_ordinal"),
        F.lit(0).cast("bigint").alias("window_index"),
        F.lit("chr1").alias("chromosome"),
        start.alias("reference_start"),
        (start + 50).alias("reference_end"),
        F.md5(F.col("id").cast("string")).alias("query_subseq"),
    )
    peaks = spark.range(n).select(
        F.lit("chr1").alias("chrom"), (F.col("id") * 40 + 3).alias("start"), (F.col("id") * 40 + 43).alias("end")
    )
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = labels.by_overlap(windows, peaks, 25, window_size=50)
        assert df.where("labels = 1").count() + df.where("labels = 0").count() == n
        rows = df.groupBy("labels").agg(F.max("query_subseq"))
        rows.collect()
        assert "skew=true" in plan_of(rows)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
