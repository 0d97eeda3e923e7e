"""Positive and negative windows by their overlap with peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readwindows.operators.intervals import (
    Cells,
    cell_of,
    choose_cells,
    fits,
    listed_cells,
    overlap_bp,
    widest,
)
from readwindows.session import broadcast_up_to

BROADCAST_ENTRIES = 2_000_000
MODES = ("max", "first")
#: How much wider than needed cells may be where peaks are sparse: a peak is then listed under fewer of them.
WIDER = 8


def _peaks_per_cell(peaks: DataFrame, cells: Cells, mode: str) -> DataFrame:
    """One row per (contig, cell) with the peaks that can decide a window of that cell.

    A window of cell ``c`` lies within cells ``c`` and ``c+1``; peaks are clipped to them.
    Of the peaks with one clipped start only the longest can have the largest overlap,
    and of those with one clipped end only the earliest can come first. So a list has at
    most two entries per base of a cell however many peaks pile up, and the reduction
    runs before the shuffle.
    """
    low, high = F.col("cell") * cells.width, (F.col("cell") + 2) * cells.width
    listed = (
        peaks.select("chrom", F.col("start").alias("ps"), F.col("end").alias("pe"))
        .where("pe > ps")
        .withColumn("cell", listed_cells(F.col("ps"), F.col("pe"), cells.width))
        .withColumn("s", F.greatest("ps", low))
        .withColumn("e", F.least("pe", high))
    )
    if mode == "max":
        deciding = listed.groupBy("chrom", "cell", "s").agg(F.max("e").alias("e"))
        entry = F.struct("s", "e")
    else:
        deciding = listed.groupBy("chrom", "cell", "e").agg(F.min(F.struct("ps", "pe")).alias("first"))
        entry = F.struct("first.ps", "first.pe", "e")
    return deciding.groupBy("chrom", "cell").agg(F.collect_list(entry).alias("peaks"))


def _window_overlap(mode: str, start: Column, end: Column) -> Column:
    """The deciding overlap among the ``peaks`` of the window's cell."""
    if mode == "max":
        best = F.aggregate(
            "peaks",
            F.lit(0).cast("bigint"),
            lambda most, p: F.greatest(most, overlap_bp(start, end, p["s"], p["e"])),
        )
    else:

        def hit(p: Column) -> Column:
            bp = overlap_bp(start, end, p["ps"], p["e"])
            return F.when(bp > 0, F.struct(p["ps"].alias("ps"), p["pe"].alias("pe"), bp.alias("bp")))

        none = F.lit(None).cast("struct<ps:bigint,pe:bigint,bp:bigint>")
        best = F.aggregate("peaks", none, lambda first, p: F.least(first, hit(p)))["bp"]
    return F.coalesce(best, F.lit(0))


def by_overlap(
    windows: DataFrame,
    peaks: DataFrame,
    min_overlap: int,
    mode: str = "max",
    window_size: int | None = None,
    cells: Cells | None = None,
) -> DataFrame:
    """Add ``overlap_bp`` and ``labels``: 1 iff the overlap reaches ``min_overlap``.

    ``mode='max'`` takes the largest overlap with any single peak, ``mode='first'`` the
    overlap with the first peak by (start, end). Small overlaps make a negative window.

    Each window meets at most one row, so the join neither multiplies windows nor needs
    them grouped again. ``window_size`` bounds the windows' reference width; without it
    one pass finds it. One small aggregate over the peaks runs first, unless its result
    is given as ``cells``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown label mode: {mode}")
    cells = cells or choose_cells(peaks, window_size or widest(windows), wider=WIDER)
    table = _peaks_per_cell(peaks, cells, mode)
    start, end = F.col("reference_start"), F.col("reference_end")
    return (
        windows.withColumn("_cell", cell_of(fits(start, end, cells.width), cells.width))
        .join(
            broadcast_up_to(table, cells.listed, BROADCAST_ENTRIES),
            (F.col("chromosome") == F.col("chrom")) & (F.col("_cell") == F.col("cell")),
            "left",
        )
        .withColumn("overlap_bp", _window_overlap(mode, start, end))
        .withColumn("labels", (F.col("overlap_bp") >= min_overlap).cast("int"))
        .select(*windows.columns, "overlap_bp", "labels")
    )


def counts(labelled: DataFrame, by: str | None = "source_file") -> DataFrame:
    """Positive and negative windows per ``by``, or in total."""
    positive = F.count_if(F.col("labels") == 1).alias("positive")
    negative = F.count_if(F.col("labels") == 0).alias("negative")
    return (labelled.groupBy(by) if by else labelled).agg(positive, negative)
