"""CIGAR strings of a whole Arrow batch at once: flat values and offsets instead of a row's arrays.

The operations of all reads lie one behind the other; positions are running sums less their value where the
read begins. The cost is a few array passes per letter of the CIGAR, whatever the length of a single one.
Results are those of ``cigar.blocks``: null and ``*`` have no blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from readwindows.functions import cigar



def _flags(codes: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in codes]] = 1
    return out


_PAIRED, _QUERY, _REFERENCE = (_flags(c) for c in (cigar.PAIRED, cigar.ADVANCES_QUERY, cigar.ADVANCES_REFERENCE))
_KNOWN = _flags(tuple("MIDNSHP=X")) > 0


def _operations(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and code of all operations, and the n + 1 offsets of the rows among them."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    digit = (text >= 0x30) & (text <= 0x39)
    # A code is a known letter behind a digit of the same row; a number begins behind anything else.
    ends = np.flatnonzero(_KNOWN[text] & np.concatenate(([False], digit[:-1])))
    row_start = np.repeat(at[:-1], np.diff(at))
    ends = ends[ends > row_start[ends]] if len(ends) else ends
    other = np.concatenate(([-1], np.flatnonzero(~digit)))
    first = np.maximum(other[np.searchsorted(other, ends) - 1] + 1, row_start[ends]) if len(ends) else ends
    n = np.zeros(len(ends), np.int64)
    width = ends - first
    for k in range(int(width.max(initial=0))):
        more = width > k
        n[more] = n[more] * 10 + (text[first[more] + k] - 0x30)
    return n, text[ends], np.searchsorted(ends, at)


def _before(steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the earlier steps of the same row."""
    sums = np.concatenate(([0], np.cumsum(steps)))
    return sums[:-1] - np.repeat(sums[at[:-1]], np.diff(at))


def ragged_blocks(column: pa.Array, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """p, n, q and r of all gap-free blocks, and the n + 1 offsets of the rows among them."""
    n, code, at = _operations(column)
    p, q = _before(n * _PAIRED[code], at), _before(n * _QUERY[code], at)
    r = _before(n * _REFERENCE[code], at) + np.repeat(start, np.diff(at))
    kept = _PAIRED[code] > 0
    offsets = np.concatenate(([0], np.cumsum(kept)))[at]
    return p[kept], n[kept], q[kept], r[kept], offsets


_WINDOW = ("i", "query_start", "query_end", "reference_start", "reference_end")
_WINDOWS = ArrayType(StructType([StructField(name, LongType(), False) for name in _WINDOW]), False)
_BLOCKS = ArrayType(StructType([StructField(name, LongType(), False) for name in "pnqr"]), False)


def _lists(columns: list[np.ndarray], names: Sequence[str], offsets: np.ndarray) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=[pa.field(name, pa.int64(), False) for name in names])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def ragged_windows(column: pa.Array, start: np.ndarray, size: int, step: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of all windows, and the n + 1 offsets of the rows among them; see ``cigar.windows``."""
    p, n, q, r, at = ragged_blocks(column, start)
    sums = np.concatenate(([0], np.cumsum(n)))
    pairs = sums[at[1:]] - sums[at[:-1]]
    counts = np.where(pairs >= size, (pairs - size) // step + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    i = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    # Pairs of all rows are numbered on, so one search finds the blocks that hold a window's first and last pair.
    first, last = (np.searchsorted(sums[:-1], sums[at[row]] + x, side="right") - 1 for x in (i, i + size - 1))
    fields = [i, q[first] + i - p[first], q[last] + i + size - p[last], r[first] + i - p[first], r[last] + i + size - p[last]]
    whole = fields[4] - fields[3] == size
    return [f[whole] for f in fields], np.concatenate(([0], np.cumsum(np.bincount(row[whole], minlength=len(counts)))))


@F.arrow_udf(_WINDOWS)
def _windows(cigars: pa.Array, starts: pa.Array, size: pa.Array, step: pa.Array) -> pa.Array:
    columns, offsets = ragged_windows(cigars, starts.fill_null(0).to_numpy(zero_copy_only=False), size[0].as_py(), step[0].as_py())
    return _lists(columns, _WINDOW, offsets)


def windows(cigar_text: Column, reference_start: Column, size: int, step: int) -> Column:
    """As ``cigar.windows``."""
    return _windows(cigar_text, reference_start.cast("bigint"), F.lit(size), F.lit(step))


@F.arrow_udf(_BLOCKS)
def _blocks(cigars: pa.Array, starts: pa.Array) -> pa.Array:
    *columns, offsets = ragged_blocks(cigars, starts.fill_null(0).to_numpy(zero_copy_only=False))
    return _lists(columns, "pnqr", offsets)


def blocks(cigar_text: Column, reference_start: Column) -> Column:
    """As ``cigar.blocks``."""
    return _blocks(cigar_text, reference_start.cast("bigint"))
