"""Slices of nucleotide text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_bases(bases: Column, start: Column, end: Column) -> Column:
    """``bases[start:end]`` of a binary column of single-byte letters, as a string.

    Finding a character in a string walks over all characters before it; a byte offset
    does not, which matters when many windows are cut from one long read.
    """
    return F.substring(bases, (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def prefix(sequence: Column, n: int) -> Column:
    return F.substring(sequence, 1, n)
