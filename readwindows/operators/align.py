"""Alignments as tables: gap-free blocks and base-level pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.functions import cigar_batch
from readwindows.operators.reads import KEY


def blocks(reads: DataFrame) -> DataFrame:
    """One row per gap-free block: pair index ``p``, length ``n``, positions ``q`` and ``r``.

    Found for a whole Arrow batch at once, without a shuffle.
    """
    return reads.select(
        *KEY, F.inline(cigar_batch.blocks(F.col("cigar"), F.col("reference_start")))
    )


def pairs(reads: DataFrame) -> DataFrame:
    """One row per aligned base: ``pair_index``, ``query_pos``, ``ref_pos``.

    The base-level table; windows do not need it.
    """
    return (
        blocks(reads)
        .where(F.col("n") > 0)
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
        .select(
            *KEY,
            (F.col("p") + F.col("k")).alias("pair_index"),
            (F.col("q") + F.col("k")).alias("query_pos"),
            (F.col("r") + F.col("k")).alias("ref_pos"),
        )
    )
