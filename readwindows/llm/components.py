"""Connected components by alternating stars, in joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.session import stage


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Point the neighbours of every node at the smallest node around it.

    The large star moves the larger neighbours, the small star the others and the node itself.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u").where("v <> m" if small else "v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if small:
        moved = moved.unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.distinct()


def _done(edges: DataFrame) -> bool:
    """Whether the edges are stars already: every node points at one other, which points at none."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("out")))
    nodes = ends.groupBy("v").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return not nodes.where("out > 1 or (out > 0 and least = 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    ``edges`` has two columns of longs; direction, repeats and loops don't matter. Rounds grow
    with the logarithm of the longest path; each half is written to the shared folder, as the next one reads it
    several times. Edges always point at the smaller node, so stars point at the smallest.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = stage(now, "edges")
    while not _done(now):
        for small in (False, True):
            now = stage(_stars(now, small), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
