"""Settings of the pipeline, as one frozen object instead of configuration files."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # The published defaults of the pipeline.
    window_size: int = 500
    step_size: int = 500
    contig: str = "chr1"
    min_mapping_quality: int = 20
    min_overlap: int = 250
    seq_len: int = 500
    kmer_size: int = 6
    batch_size: int = 64
    seed: int = 42
    val_fraction: float = 0.2
    test_fraction: float = 0.2
