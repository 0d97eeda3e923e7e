"""Reads and peaks to labelled windows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from readwindows.operators import dataset, labels, peaks as peak_ops, reads as read_ops, windows
from readwindows.operators.intervals import Cells, choose_cells
from readwindows.params import Params


def label_windows(
    reads: DataFrame,
    peaks: DataFrame,
    params: Params,
    mode: str = "max",
    sequences: bool = True,
    cells: Cells | None = None,
) -> DataFrame:
    """Eligible reads, their windows, and each window's label.

    Without the per-file balance. Narrow but for the small peak table: reads are filtered
    at the scan, expanded in place and probed against broadcast peaks.
    """
    chosen = read_ops.eligible(reads, params)
    found = windows.slide(chosen, params.window_size, params.step_size, sequences)
    on_contig = peak_ops.on_contig(peaks, params.contig)
    return labels.by_overlap(found, on_contig, params.min_overlap, mode, params.window_size, cells)


def make_windows(reads: DataFrame, peaks: DataFrame, params: Params, mode: str = "max") -> DataFrame:
    """Labelled windows, with negatives sampled down to the positives of their file.

    Reads are scanned twice: to count, without cutting sequences, and to write.
    """
    cells = choose_cells(peak_ops.on_contig(peaks, params.contig), params.window_size, wider=labels.WIDER)
    labelled = label_windows(reads, peaks, params, mode, cells=cells)
    counted = label_windows(reads, peaks, params, mode, sequences=False, cells=cells)
    return dataset.downsample_per_group(labelled, "source_file", params.seed, counted=counted)
