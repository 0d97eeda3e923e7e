"""Exact ranks without handing a whole group to one task.

Random orders are the order of ``md5(seed-key)``: the same rows on every run and every
cluster. Digests are uniform, so their first digits cut any group into even buckets; a
histogram of the buckets gives each bucket's offset, and only the inside of a bucket is
ever sorted by one task. Where it is enough to know which rows come before a rank, ``digests_at`` finds the digest at that
rank from keys alone, and the rows are only compared with it: they are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readwindows.session import broadcast_up_to, stage

BUCKET_DIGITS = 4  # 16**4 buckets per group
BROADCAST_GROUPS = 1_000_000


def digest(seed: int | str, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _with_buckets(df: DataFrame, seed: int | str, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_h", digest(seed, keys)).withColumn(
        "_bucket", F.substring("_h", 1, BUCKET_DIGITS)
    )


def _row_in_bucket(groups: Sequence[str], keys: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_h", *keys))


def _histogram(bucketed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per bucket, rows before it, and rows of the whole group."""
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.groupBy(*groups, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(group))
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    groups: Sequence[str] = (),
    name: str = "shuffle_rank",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row in its group's seeded random order.

    ``keys`` identify a row; ``groups`` must not be null. ``total`` names an optional
    column with the size of the group. ``df`` is evaluated twice, once for its keys only.
    """
    bucketed = _with_buckets(df, seed, keys)
    histogram = _histogram(bucketed, groups).drop("_rows")
    if not groups:  # at most 16**BUCKET_DIGITS rows
        histogram = F.broadcast(histogram)
    return (
        bucketed.withColumn("_n", _row_in_bucket(groups, keys))
        .join(histogram, [*groups, "_bucket"])
        .select(
            *df.columns,
            (F.col("_before") + F.col("_n")).alias(name),
            *([F.col("_total").alias(total)] if total else []),
        )
    )


def digests_at(keyed: DataFrame, groups: Sequence[str], ranks: DataFrame, buckets: DataFrame) -> DataFrame:
    """(groups, name, digest, tied): the ``k``-th digest of a group, for each row (groups, name, k) of ``ranks``.

    ``keyed`` has the groups and ``_h``; ``buckets`` is its ``_histogram``. ``tied``: rows of the same digest
    stand on both sides of the rank. Only the rows of one bucket for each rank are sorted. A staged table.
    """
    if not groups:
        keyed, ranks, buckets = (t.withColumn("_one", F.lit(1)) for t in (keyed, ranks, buckets))
    by = [*groups] or ["_one"]
    inside = ranks.join(buckets, by).where("k > _before and k <= _before + _rows")
    cuts = stage(inside.select(*by, "name", "_bucket", (F.col("k") - F.col("_before")).alias("_k")), "cuts")
    wanted = cuts.select(*by, "_bucket").distinct()
    order = Window.partitionBy(*by, "_bucket").orderBy("_h")
    rows = keyed.join(_if_small(wanted), [*by, "_bucket"], "left_semi").select(*by, "_bucket", "_h")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("_h").over(order))
    found = rows.join(cuts.withColumnRenamed("_k", "_n"), [*by, "_bucket", "_n"])
    return stage(found.select(*groups, "name", F.col("_h").alias("digest"), F.coalesce(F.col("_h") == F.col("_next"), F.lit(False)).alias("tied")), "thresholds")


def _if_small(table: DataFrame) -> DataFrame:
    return broadcast_up_to(table, table.count(), BROADCAST_GROUPS)


def match_negatives(
    labelled: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    groups: Sequence[str] = (),
    strict: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    """All positives, and per group exactly as many negatives in seeded random order.

    A group with fewer negatives keeps them all, or raises under ``strict``.
    The last digest of each group that stays is found first (actions on keys and labels only), so
    that rows are only compared with it. ``counted`` may give the same
    rows for that pass, with only the keys, groups and labels, where that is cheaper.
    Rows that share all keys count one by one: if the cut falls among them, they are ranked.
    """
    counted = labelled if counted is None else counted
    by = [*groups, "labels"]
    keyed = stage(_with_buckets(counted, seed, keys).select(*by, "_h", "_bucket"), "keys")
    sizes = keyed.groupBy(*groups).agg(F.count_if(F.col("labels") == 1).alias("_positive"), F.count_if(F.col("labels") == 0).alias("_negative"))
    sizes = stage(sizes, "sizes")
    if strict and sizes.where("_positive > _negative").limit(1).count():
        raise ValueError("fewer negative than positive samples: cannot sample without replacement")
    negatives = keyed.where("labels = 0")
    ranks = sizes.where("_positive > 0 and _negative > 0").select(*groups, F.lit("last").alias("name"), F.least("_positive", "_negative").alias("k"))
    last = digests_at(negatives, groups, ranks, _histogram(negatives, groups))
    found, tied = last.agg(F.count("*"), F.coalesce(F.max("tied"), F.lit(False))).first()
    if groups:
        last = broadcast_up_to(last.drop("name", "tied"), found, BROADCAST_GROUPS)
        known = labelled.withColumn("_h", digest(seed, keys)).join(last, [*groups], "left")
    else:
        only = last.first()
        known = labelled.withColumn("_h", digest(seed, keys)).withColumn("digest", F.lit(only.digest if only else None).cast("string"))
    positive = F.col("labels") == 1
    before = F.col("_h") <= F.col("digest")
    if not tied:
        return known.where(positive | before).select(*labelled.columns)
    # Of the rows that share the last digest only so many as are still missing.
    order = Window.partitionBy(*groups, "labels").orderBy("_h", *keys)
    low = known.where(positive | before).select(*labelled.columns, "_h")
    low = low.withColumn("_n", F.row_number().over(order))
    low = low.join(sizes, [*groups]) if groups else low.withColumn("_positive", F.lit(sizes.first()._positive))
    return low.where(positive | (F.col("_n") <= F.col("_positive"))).select(*labelled.columns)


def cut_at(df: DataFrame, keys: Sequence[str], seed: int | str, groups: Sequence[str], name: str, shares: dict[str, Column], rest: str) -> DataFrame:
    """Add ``name``: the first rows of each group in seeded random order get the first share's name, and so on.

    ``shares`` gives the last rank of each name, in order, from ``_total``, the size of the group; rows behind
    all of them get ``rest``. Rows are compared with the digests at these ranks; only if one falls among
    rows that share all keys, they are ranked.
    """
    keyed = stage(_with_buckets(df, seed, keys).select(*groups, "_h", "_bucket"), "keys")
    buckets = _histogram(keyed, groups)
    totals = stage(keyed.groupBy(*groups).agg(F.count("*").alias("_total")), "sizes")
    listed = F.array(*[F.struct(F.lit(n).alias("name"), rank.cast("bigint").alias("k")) for n, rank in shares.items()])
    ranks = totals.select(*groups, F.inline(listed)).where("k > 0")
    found = digests_at(keyed, groups, ranks, buckets)
    many, tied = found.agg(F.count("*"), F.coalesce(F.max("tied"), F.lit(False))).first()
    if tied:
        place = hash_rank(df, keys, seed, groups, name="_rank", total="_total")
        chosen = F.coalesce(*[F.when(F.col("_rank") <= rank, n) for n, rank in shares.items()], F.lit(rest))
        return place.withColumn(name, chosen).select(*df.columns, name)
    last = found.groupBy(*groups).pivot("name", list(shares)).agg(F.first("digest"))
    last = stage(last.toDF(*groups, *[f"_last_{n}" for n in shares]), "thresholds")
    known = df.withColumn("_h", digest(seed, keys)).join(broadcast_up_to(last, many, BROADCAST_GROUPS), [*groups], "left")
    chosen = F.coalesce(*[F.when(F.col("_h") <= F.col(f"_last_{n}"), n) for n in shares], F.lit(rest))
    return known.withColumn(name, chosen).select(*df.columns, name)


def ordered_positions(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add the contiguous 0-based position of each row in a stated order.

    A range-partitioned sort is written once, so that the partitions stay as they are;
    the rows before each partition (one number per partition) complete the position.
    ``order`` should identify a row.
    """
    local_row = F.monotonically_increasing_id()  # fixed layout: partition << 33 | row
    ordered = stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", local_row), "ordered"
    ).withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + row).alias(name)
    )


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order: a top-n per partition, then one merge."""
    return df.orderBy(*order).limit(n)
