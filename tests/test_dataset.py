import hashlib
import math

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from readwindows.session import stage
from readwindows import Params
from readwindows.operators import dataset, ranking
from readwindows.plans.prepare import prepare

KEYS = ["id"]


def md5(seed, key):
    return hashlib.md5(f"{seed}-{key}".encode()).hexdigest()


def rows(spark, n=3000):
    """A third of the rows in one group."""
    return spark.range(n, numPartitions=5).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("source_file"),
        (F.col("id") % 4 == 0).cast("int").alias("labels"),
    )


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_rank(spark, digits, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_DIGITS", digits)
    data = [tuple(r) for r in rows(spark).collect()]
    for groups in ([], ["source_file"]):
        found = {
            r.id: (r.shuffle_rank, r.n) for r in ranking.hash_rank(rows(spark), KEYS, 9, groups, total="n").collect()
        }
        members = {}
        for i, g, _ in data:
            members.setdefault(g if groups else "", []).append(i)
        for ids in members.values():
            for rank, i in enumerate(sorted(ids, key=lambda i: md5(9, i)), start=1):
                assert found[i] == (rank, len(ids))


@pytest.mark.parametrize("broadcast", [True, False])
def test_downsample_per_group(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(ranking, "BROADCAST_GROUPS", -1)
    df = rows(spark).withColumn(  # one file without positives, one with few negatives
        "labels",
        F.when(F.col("source_file") == "g1", 0)
        .when(F.col("source_file") == "g2", (F.col("id") % 8 != 1).cast("int"))
        .otherwise(F.col("labels")),
    )
    data = [tuple(r) for r in df.collect()]
    expected = set()
    for g in {g for _, g, _ in data}:
        pos = [i for i, f, l in data if f == g and l == 1]
        neg = sorted((i for i, f, l in data if f == g and l == 0), key=lambda i: md5(42, i))
        expected |= set(pos) | set(neg[: len(pos)])
    found = dataset.downsample_per_group(df, keys=KEYS)
    assert found.columns == df.columns
    assert sorted(r.id for r in found.collect()) == sorted(expected)


def test_balance(spark):
    found = dataset.balance(rows(spark), keys=KEYS).groupBy("labels").count().collect()
    assert {r.labels: r["count"] for r in found} == {0: 750, 1: 750}
    flipped = rows(spark).withColumn("labels", 1 - F.col("labels"))
    with pytest.raises(ValueError, match="fewer negative"):
        dataset.balance(flipped, keys=KEYS)
    assert dataset.balance(flipped, strict=False, keys=KEYS).count() == 3000
    with pytest.raises(ValueError):
        dataset.balance(rows(spark).where("labels = 1"), keys=KEYS)
    assert dataset.balance(rows(spark).where("labels = 0"), keys=KEYS).count() == 0


def test_rows_that_share_all_keys_count_one_by_one(spark):
    same = spark.range(40).select(F.lit(1).alias("id"), F.lit("f").alias("source_file"), (F.col("id") < 13).cast("int").alias("labels"))
    for found in (dataset.balance(same, keys=KEYS), dataset.downsample_per_group(same, keys=KEYS)):
        assert {r.labels: r["count"] for r in found.groupBy("labels").count().collect()} == {0: 13, 1: 13}
    sizes = {r.split: r["count"] for r in dataset.split(same.where("labels = 0"), keys=KEYS).groupBy("split").count().collect()}
    assert sizes == {"val": 6, "test": 5, "train": 16}


def test_ranks_of_the_split(spark):
    data = [tuple(r) for r in rows(spark).collect()]
    expected = {}
    for label in (0, 1):
        ids = sorted((i for i, _, l in data if l == label), key=lambda i: md5(42, i))
        val = math.ceil(0.2 * len(ids))
        test = math.ceil(0.2 * (len(ids) - val))
        expected |= {i: "val" if k < val else "test" if k < val + test else "train" for k, i in enumerate(ids)}
    assert {r.id: r.split for r in dataset.split(rows(spark), keys=KEYS).collect()} == expected


def test_payloads_are_not_shuffled(spark):
    df = stage(window_rows(spark).unionByName(window_rows(spark).withColumn("window_index", F.col("window_index") + 10)), "rows")
    for made in (dataset.downsample_per_group(df), dataset.balance(df, strict=False), dataset.split(df)):
        plan = plan_of(made)
        assert "query_subseq" in plan and "Window" not in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    single = stage(window_rows(spark).where("note <> 'second'"), "rows")
    plan = plan_of(dataset.dedup(single))
    unique = plan.split("(1) Scan")[0].split("Union")[1].split("SortAggregate")[0]
    assert "BroadcastHashJoin LeftAnti" in unique and "Exchange" not in unique.replace("BroadcastExchange", "")


def test_dedup_compares_in_full(spark, monkeypatch):
    # Fingerprints of the pairs (label, sequence) that are all but sure to be alike: few of them, by a short hash.
    monkeypatch.setattr(dataset.F, "xxhash64", lambda *columns: F.length(F.concat_ws("", *columns)))
    data = [("f", k, 0, f"S{k % 50:02d}", k % 2) for k in range(400)]
    df = spark.createDataFrame(data, "source_file string, read_ordinal bigint, window_index bigint, query_subseq string, labels int")
    found = sorted((r.query_subseq, r.labels, r.read_ordinal) for r in dataset.dedup(df).collect())
    assert found == sorted((f"S{k:02d}", k % 2, k) for k in range(50))


@pytest.mark.parametrize("words", [1, 1 << 21])
def test_dedup_of_many_repeated_rows_shuffles_no_others(spark, words, monkeypatch):
    monkeypatch.setattr(dataset, "BROADCAST_PRINTS", 0)
    monkeypatch.setattr(dataset, "PRINT_WORDS", words)
    rows = [("f", i, 0, "ACGT" * (i % 40), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "source_file string, read_ordinal bigint, window_index bigint, query_subseq string, labels int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dataset.dedup(stage(df))
        assert "SortMergeJoin" not in plan_of(kept)
        first = {}
        for row in rows:
            first.setdefault(row[3:], row)
        assert sorted(map(tuple, kept.select(df.columns).collect())) == sorted(first.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ordered_positions(spark):
    df = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("v"))
    found = ranking.ordered_positions(df, ["v"], "at").collect()
    assert [r.v for r in sorted(found, key=lambda r: r.at)] == sorted(r.v for r in found)
    assert sorted(r.at for r in found) == list(range(5000))


def window_rows(spark):
    data = [
        ("b", 1, 0, "AAAA", 1, "late"),
        ("a", 2, 0, "AAAA", 1, "second"),
        ("a", 1, 3, "AAAA", 1, "first"),
        ("a", 1, 1, "AAAA", 0, "other class"),
        ("a", 1, 2, "CCCC", 0, "single"),
    ]
    schema = "source_file string, read_ordinal bigint, window_index bigint, query_subseq string, labels int, note string"
    return spark.createDataFrame(data, schema)


def test_dedup_keeps_the_first(spark):
    kept = dataset.dedup(window_rows(spark))
    assert kept.columns == window_rows(spark).columns
    assert sorted(r.note for r in kept.collect()) == ["first", "other class", "single"]
    plan = plan_of(kept)
    assert "Window" not in plan and plan.count("Aggregate") >= 2  # combined before the shuffle


@pytest.mark.parametrize("n", [1, 5, 6, 35, 100])
def test_split_sizes(spark, n):
    df = spark.range(2 * n).select("id", (F.col("id") % 2).cast("int").alias("labels"))
    found = {(r.labels, r.split): r["count"] for r in dataset.split(df, keys=KEYS).groupBy("labels", "split").count().collect()}
    val = math.ceil(0.2 * n)
    test = math.ceil(0.2 * (n - val))
    for label in (0, 1):
        sizes = {s: found.get((label, s), 0) for s in dataset.SPLITS}
        assert sizes == {"val": val, "test": test, "train": n - val - test}


def test_leakage(spark):
    data = [("A", "train"), ("A", "train"), ("B", "train"), ("B", "test"), ("C", "test"), ("C", "val"), ("D", "val")]
    df = spark.createDataFrame([(s, 1, p) for s, p in data], "query_subseq string, labels int, split string")
    assert tuple(dataset.leakage(df).first()) == (1, 0, 1)
    with pytest.raises(ValueError, match="leak"):
        dataset.assert_no_leakage(df)
    clean = df.where("query_subseq != 'B'")
    assert dataset.assert_no_leakage(clean) == (0, 0, 1)
    tables = {s: dataset.part(df, s) for s in dataset.SPLITS}
    tagged = dataset.tag_splits(tables["train"], tables["test"], tables["val"])
    assert tuple(dataset.leakage(tagged).first()) == (1, 0, 1)


def test_batches(spark):
    df = spark.range(130)
    ordered = {r.id: r.batch for r in dataset.batches(df, 64, KEYS).collect()}
    assert ordered == {i: i // 64 for i in range(130)}
    by_epoch = []
    for epoch in (0, 1):
        found = dataset.batches(df, 64, KEYS, seed=1, epoch=epoch)
        assert sorted(r["count"] for r in found.groupBy("batch").count().collect()) == [2, 64, 64]
        by_epoch.append({r.id: r.batch for r in found.collect()})
    assert by_epoch[0] != by_epoch[1]


def test_union_label_truncate(spark):
    df = spark.createDataFrame([("ACGTACGT",), ("AC",), ("",)], "query_subseq string")
    both = dataset.combine(dataset.label(df, 1), dataset.label(df, 0))
    assert both.count() == 6 and {r.labels for r in dataset.label_values(both).collect()} == {0, 1}
    assert [r.query_subseq for r in dataset.truncate(df, 4).collect()] == ["ACGT", "AC", ""]


def test_prepare(spark):
    n = 400
    letters = F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    df = spark.range(n).select(
        F.lit("f").alias("source_file"),
        F.col("id").alias("read_ordinal"),
        F.lit(0).cast("bigint").alias("window_index"),
        letters.alias("query_subseq"),
        (F.col("id") % 4 == 0).cast("int").alias("labels"),
    )
    doubled = df.unionByName(df.withColumn("window_index", F.lit(1).cast("bigint")))
    made = prepare(doubled, Params(seq_len=30))
    combined = made.combined.collect()
    assert len(combined) == n // 2 and {r.window_index for r in combined} == {0}
    assert sorted(r.shuffle_rank for r in combined) == list(range(1, n // 2 + 1))
    assert {len(r.query_subseq) for r in combined} == {30}
    sizes = {r.split: r["count"] for r in made.splits.groupBy("split").count().collect()}
    assert sizes == {"val": 40, "test": 32, "train": 128}
    assert dataset.assert_no_leakage(made.splits) == (0, 0, 0)
    again = {(r.read_ordinal, r.split) for r in prepare(doubled, Params(seq_len=30)).splits.collect()}
    assert again == {(r.read_ordinal, r.split) for r in made.splits.collect()}
    short = prepare(doubled, Params(seq_len=2), dedup_after_truncate=True)
    assert short.combined.count() <= 16
