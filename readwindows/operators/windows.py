"""Sliding windows over aligned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readwindows.functions import cigar_batch
from readwindows.functions.lets import let
from readwindows.functions.sequences import slice_bases
from readwindows.operators.reads import KEY

WINDOW_KEY = [*KEY, "window_index"]
SAMPLE_COLUMNS = [
    "chromosome",
    "query_name",
    "reference_start",
    "reference_end",
    "query_start",
    "query_end",
    "query_subseq",
    "mapping_quality",
    "query_length",
]


def slide(reads: DataFrame, size: int, step: int, sequences: bool = True) -> DataFrame:
    """Windows of ``size`` aligned pairs every ``step`` pairs, without reference gaps.

    ``window_index`` is the place on the read's grid, counting rejected windows. A window
    with an insertion inside spans more than ``size`` query bases. A narrow operation:
    windows are found for a whole Arrow batch of CIGARs at once; sequences never leave the JVM, and nothing is shuffled.
    ``sequences=False`` leaves ``query_subseq`` out, for passes that only count.
    """
    placed = reads.withColumn("_offsets", cigar_batch.windows(F.col("cigar"), F.col("reference_start"), size, step))

    def window(w: Column, bases: Column | None = None) -> Column:
        fields = [
            F.floor(w["i"] / step).alias("window_index"),
            *[w[c].alias(c) for c in ("reference_start", "reference_end", "query_start", "query_end")],
        ]
        if bases is not None:
            fields.append(slice_bases(bases, w["query_start"], w["query_end"]).alias("query_subseq"))
        return F.struct(*fields)

    if sequences:
        found = let(
            F.col("query_sequence").cast("binary"),
            lambda bases: F.transform("_offsets", lambda w: window(w, bases)),
        )
    else:
        found = F.transform("_offsets", lambda w: window(w))
    columns = [c for c in SAMPLE_COLUMNS if sequences or c != "query_subseq"]
    return placed.select(
        *KEY,
        F.col("reference_name").alias("chromosome"),
        "query_name",
        "mapping_quality",
        "query_length",
        F.inline(found),
    ).select(*WINDOW_KEY, *columns)
