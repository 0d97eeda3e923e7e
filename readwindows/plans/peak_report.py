"""Everything reported about a peak table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from readwindows.operators import peaks as peak_ops


@dataclass(frozen=True)
class PeakReport:
    summary: DataFrame  # over all contigs
    widths: DataFrame  # the rest is about one contig
    histogram: DataFrame
    density: DataFrame
    series: DataFrame


def peak_report(peaks: DataFrame, contig: str, order: Sequence[str] = ("chrom", "start", "end")) -> PeakReport:
    chosen = peak_ops.on_contig(peaks, contig)
    return PeakReport(
        summary=peak_ops.width_summary(peaks),
        widths=peak_ops.with_width(chosen),
        histogram=peak_ops.width_histogram(chosen),
        density=peak_ops.width_density(chosen),
        series=peak_ops.width_series(peaks, contig, order),
    )
