"""Operators on aligned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.functions import cigar
from readwindows.params import Params

KEY = ["source_file", "read_ordinal"]
REVERSE_FLAG = 16  # fixed value: the reverse-strand bit of SAM flags


def eligible(reads: DataFrame, params: Params) -> DataFrame:
    """Reads with a sequence, a good mapping and enough length, on the chosen contig.

    No strand, flag or duplicate filter. The comparisons reach Parquet scans.
    """
    return reads.where(
        (F.col("reference_name") == params.contig)
        & (F.col("mapping_quality") >= params.min_mapping_quality)
        & (F.col("query_length") >= params.window_size)
        & F.col("query_sequence").isNotNull()
        & (F.col("query_sequence") != "None")
    )


def with_extent(reads: DataFrame) -> DataFrame:
    """Add ``reference_length``, ``reference_end`` and ``is_reverse``."""
    return (
        reads.withColumn("reference_length", cigar.reference_length(F.col("cigar")))
        .withColumn("reference_end", F.col("reference_start") + F.col("reference_length"))
        .withColumn("is_reverse", F.col("flag").bitwiseAND(REVERSE_FLAG) != 0)
    )


def summary(reads: DataFrame) -> DataFrame:
    return with_extent(reads).select(
        F.col("reference_name").alias("chromosome"),
        "query_name",
        "reference_start",
        "reference_end",
        "mapping_quality",
        "query_length",
        "reference_length",
        "is_reverse",
    )
