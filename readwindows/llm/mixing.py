"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / weight: u is fixed by its id and the seed, the weight by its
quality label. Ascending keys are a weighted draw without replacement. A source gives whole
epochs while its target lasts; the rest of the target is taken in key order, the document at
the edge in part, so every target is met to the word.

The running total is found in two steps: one sum per source and key bucket gives the bucket
in which the target ends, and only the documents of that bucket are put in order. No source
is ever sorted as a whole, however large.

Defined cases: null and empty texts have size 0 and nothing is taken of them; a null source is
one more source, the last; a source of size 0 has target 0; equal rows have equal keys and
are drawn one by one; a document without a label has weight 1, of several labels the best
counts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readwindows.session import broadcast_up_to, stage

SOURCE_WEIGHTS = (3, 1, 2)
TOTAL_PERCENT, MOST_EPOCHS = 150, 2
#: Draw weight by quality label.
QUALITY_WEIGHTS = {0: 0.5, 1: 2.0}
BUCKETS = 1 << 14
SEED = "mix-1"
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame, labels: DataFrame, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, key, and the columns in ``keep``."""
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"))
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *keep,
    )
    weight = F.lit(1.0)
    for label, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("q") == label, value).otherwise(weight)
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return sizes.join(quality, "doc_id", "left").select("doc_id", "source", "size", (-F.ln(u) / weight).alias("key"), *keep)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: shares by weight, none above its cap.

    One row per source. With shares w * level, the sources whose cap lies below their share
    are those of the smallest cap / w; the level follows from how many these are.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(SOURCE_WEIGHTS)
    weights = F.array(*[F.lit(float(w)) for w in SOURCE_WEIGHTS])
    rows = sources.select("*", F.element_at(weights, (place + 1).cast("int")).alias("w"), (F.col("source_size") * MOST_EPOCHS).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.select(
        "*",
        (F.sum("source_size").over(whole) * TOTAL_PERCENT / 100 - F.coalesce(F.sum("cap").over(order), F.lit(0.0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(order), F.lit(0.0))).alias("w_left"),
    )
    # A source is free if the level over it and all later ones stays within its cap.
    level = F.min(F.when(F.col("left") / F.col("w_left") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), "source", (F.col("left") / F.col("w_left")).alias("level")))).over(whole)
    target = F.least("cap", F.coalesce(F.col("w") * level["level"], F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, labels: DataFrame, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target and taken, the words that the mix takes of it, and the columns in ``keep``."""
    rows = stage(keyed(docs, labels, seed, keep).withColumn("bucket", (BUCKETS * (1 - F.exp(-F.col("key")))).cast("int")), "keys")
    plan = stage(targets(rows), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("before", before).join(plan.select("source", "budget").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    edges = edges.where("before <= budget and budget < before + s").select(F.col("source").alias("of"), F.col("bucket").alias("edge"), "before")
    plan = plan.join(edges, plan["source"].eqNullSafe(edges["of"]), "left").drop("of").withColumnRenamed("source", "of")
    plan = stage(plan, "plan")
    plan = broadcast_up_to(plan, plan.count(), BROADCAST_SOURCES)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    base = F.col("epochs") * F.col("size")
    inside = joined.where("bucket = edge")
    earlier = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("before") - earlier))
    columns = ["doc_id", "size", "source_size", "target", *keep]
    taken = inside.select(*columns, (base + part).cast("long").alias("taken"))
    # Without an edge the budget is a whole number of epochs, or covers the source.
    whole = F.when((F.col("bucket") < F.col("edge")) | (F.col("edge").isNull() & (F.col("budget") > 0)), F.col("size")).otherwise(0)
    rest = joined.where("edge is null or bucket <> edge").select(*columns, (base + whole).cast("long").alias("taken"))
    return rest.unionByName(taken)
