"""Operators on peak tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readwindows.operators.ranking import ordered_positions

# Fixed values of the width report.
BINS = 20
GRID = 200
WIDTH_COLUMNS = ["chr_name", "peak_start", "peak_end", "peak_range"]


def to_bed3(peaks: DataFrame) -> DataFrame:
    return peaks.select("chrom", "start", "end")


def on_contig(peaks: DataFrame, contig: str) -> DataFrame:
    return peaks.where(F.col("chrom") == contig)


def width() -> Column:
    return F.col("end") - F.col("start")


def with_width(peaks: DataFrame) -> DataFrame:
    return peaks.select("chrom", "start", "end", width()).toDF(*WIDTH_COLUMNS)


def width_summary(peaks: DataFrame) -> DataFrame:
    """Minimum, maximum, exact median and mean width: one row."""
    return peaks.agg(
        F.min(width()).alias("min_width"),
        F.max(width()).alias("max_width"),
        F.median(width()).alias("median_width"),
        F.avg(width()).alias("mean_width"),
    )


def _widths(peaks: DataFrame) -> DataFrame:
    """Distinct widths with their number; all reports start from this small table."""
    return peaks.groupBy(width().cast("double").alias("w")).agg(F.count("*").alias("n"))


def width_histogram(peaks: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts in ``bins`` equal bins from the least to the greatest width, empty ones too.

    The last bin is closed. When all widths are equal there is a single bin.
    """
    bounds = F.struct(F.min("w").alias("lo"), F.max("w").alias("hi"))
    range_ = _widths(peaks).agg(bounds).scalar()
    step = (F.col("b.hi") - F.col("b.lo")) / bins
    place = F.when(F.col("b.hi") == F.col("b.lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("w") - F.col("b.lo")) / step), F.lit(bins - 1))
    )
    filled = (
        _widths(peaks).withColumn("b", range_).groupBy(place.cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    )
    grid = peaks.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("b", range_)
    wanted = (F.col("bin") == 0) | (F.col("b.hi") > F.col("b.lo"))
    return (
        grid.where(F.col("b.lo").isNotNull() & wanted)
        .join(filled, "bin", "left")
        .select(
            "bin",
            (F.col("b.lo") + F.col("bin") * step).alias("bin_start"),
            (F.col("b.lo") + (F.col("bin") + 1) * step).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("peaks"),
        )
    )


def width_density(peaks: DataFrame, points: int = GRID, bins: int = BINS) -> DataFrame:
    """Gaussian density of the widths at ``points`` places from least to greatest.

    Bandwidth by Scott's rule. ``count_scale`` is the density on the histogram's scale.
    Each distinct width is weighted by its number and spread over the grid, which is
    added up again before the shuffle. Equal widths, or fewer than two, have no density: no rows.
    """
    stats = peaks.agg(
        F.struct(
            F.min(width()).cast("double").alias("lo"),
            F.max(width()).cast("double").alias("hi"),
            F.count("*").alias("n"),
            (F.stddev_samp(width()) * F.pow(F.count("*"), F.lit(-0.2))).alias("h"),
        )
    ).scalar()
    lo, hi, n, h = (F.col(f"s.{c}") for c in ("lo", "hi", "n", "h"))
    at = lo + F.col("point") * (hi - lo) / (points - 1)
    kernel = F.exp(F.lit(-0.5) * F.pow((at - F.col("w")) / h, F.lit(2)))
    spread = _widths(peaks).withColumn("s", stats).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    total = F.sum(F.col("n") * kernel)
    norm = n * h * F.sqrt(2 * F.pi())
    return (
        spread.where("s.h > 0")
        .groupBy("point")
        .agg(total.alias("total"))
        .withColumn("s", stats)
        .select(
            "point",
            at.alias("x"),
            (F.col("total") / norm).alias("density"),
            (F.col("total") / norm * n * (hi - lo) / bins).alias("count_scale"),
        )
    )


def width_series(peaks: DataFrame, contig: str, order: Sequence[str]) -> DataFrame:
    """Row index in the whole table and width, for the peaks of one contig."""
    return on_contig(ordered_positions(peaks, order, "peak_ordinal"), contig).select(
        "peak_ordinal", width().alias("peak_range")
    )
