"""Interval overlap on half-open ``[start, end)`` ranges.

Spark has no range join; a join on the contig alone compares everything with everything.
Here each interval of the left side gets exactly one cell, the one its start lies in.
Each interval of the right side is listed under every cell whose left intervals could
reach it. With cells at least as wide as the widest left interval, the equi-join on
(contig, cell) then meets every overlapping pair exactly once, so neither side needs
de-duplication and a left join needs no second pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readwindows.session import broadcast_up_to

WINDOW_COLS = ("chromosome", "reference_start", "reference_end")
PEAK_COLS = ("chrom", "start", "end")
# Above this many listed rows the right side is shuffled instead of broadcast.
BROADCAST_ROWS = 250_000
#: Mean number of right intervals in reach of a cell up to which it may be widened.
SPARSE = 2


@dataclass(frozen=True)
class Cells:
    """Width of the cells, and a bound on the rows the right side is listed under."""

    width: int
    listed: int


def widest(df: DataFrame, cols: tuple[str, str, str] = WINDOW_COLS) -> int:
    """Width of the widest interval (an action)."""
    return df.agg(F.max(F.col(cols[2]) - F.col(cols[1]))).first()[0] or 1


def choose_cells(right: DataFrame, left_width: int, cols: tuple[str, str, str] = PEAK_COLS, wider: int = 1) -> Cells:
    """Cells for intervals up to ``left_width`` wide (an action on the right side).

    At least a quarter of the mean right interval, so that listing multiplies the right
    side by at most seven whatever its longest interval is. Up to ``wider`` times as wide as that, while
    a cell meets ``SPARSE`` right intervals or fewer on average: then they are listed less often.
    """
    start, end = F.col(cols[1]), F.col(cols[2])
    rows, total, low, high = right.agg(F.count("*"), F.coalesce(F.sum(end - start), F.lit(0)), F.min(start), F.max(end)).first()
    mean = total / rows if rows else 0
    size = 1 << (math.ceil(max(left_width, mean / 4, 1)) - 1).bit_length()
    most = size * wider
    while rows and 2 * size <= most and rows * (4 * size + mean) <= SPARSE * ((high or 0) - (low or 0)):
        size *= 2
    return Cells(width=size, listed=int(total / size) + 3 * rows)


def cell_of(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def listed_cells(start: Column, end: Column, width: int) -> Column:
    """All cells whose left intervals may overlap ``[start, end)``."""
    return F.explode(F.sequence(cell_of(start, width) - 1, cell_of(end - 1, width)))


def overlap_bp(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def fits(start: Column, end: Column, width: int) -> Column:
    """``start``, or an error when the interval is wider than a cell: results stay whole."""
    message = F.lit(f"interval wider than the cell width {width}")
    return F.when(end - start > width, F.raise_error(message)).otherwise(start)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    min_overlap: int = 1,
    left_cols: tuple[str, str, str] = WINDOW_COLS,
    right_cols: tuple[str, str, str] = PEAK_COLS,
    left_width: int | None = None,
) -> DataFrame:
    """All overlapping pairs with the columns of both sides and ``overlap_bp``.

    ``left_width`` is an upper bound of the left widths; without it one pass finds it.
    ``how='left'`` keeps left rows without a partner, with 0 overlap. A cell holding much
    of both sides is split by adaptive skew handling when the right side is shuffled.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    cells = choose_cells(right, left_width or widest(left, left_cols), right_cols)
    l_contig, l_start, l_end = (F.col(f"l.{c}") for c in left_cols)
    r_contig, r_start, r_end = (F.col(f"r.{c}") for c in right_cols)

    anchored = left.withColumn(
        "_cell", cell_of(fits(F.col(left_cols[1]), F.col(left_cols[2]), cells.width), cells.width)
    )
    listed = right.where(F.col(right_cols[2]) > F.col(right_cols[1])).withColumn(
        "_cell", listed_cells(F.col(right_cols[1]), F.col(right_cols[2]), cells.width)
    )
    bp = overlap_bp(l_start, l_end, r_start, r_end)
    return (
        anchored.alias("l")
        .join(
            broadcast_up_to(listed, cells.listed, BROADCAST_ROWS).alias("r"),
            (l_contig == r_contig)
            & (F.col("l._cell") == F.col("r._cell"))
            & (l_start < r_end)
            & (r_start < l_end)
            & (bp >= min_overlap),
            how,
        )
        .select(
            *[f"l.{c}" for c in left.columns],
            *[f"r.{c}" for c in right.columns],
            F.when(r_start.isNull(), F.lit(0)).otherwise(bp).cast("bigint").alias("overlap_bp"),
        )
    )
