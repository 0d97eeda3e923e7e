"""Whole texts as byte arrays: words, fingerprints and pieces of bounded size, in NumPy.

Every function works on UTF-8 bytes. Word classes are unions of byte ranges in which all
bytes from 0x80 on are alike, so they may be tested byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task handles at once; a longer single text is a piece of its own.
PIECE = 1 << 20
#: Odd multiplier of the polynomial fingerprints modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = pow(int(BASE), -1, 1 << 64)


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Words of letters, digits and all characters beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words between white space.
NON_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = int(BASE)) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next piece."""
    return _powers(base, max(PIECE + (PIECE >> 1), 1 << int(n).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit fingerprints evenly (a finalizer of multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """n + 1 sums from which the fingerprint of any stretch follows, see ``stretch``."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end], the same wherever the stretch stands."""
    return (sums[ends] - sums[starts]) * powers(len(sums), INVERSE)[starts]


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as large binary, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large binary column in one array, and the n + 1 offsets of its rows."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``flat``, with one space behind every row, so that no word runs into the next row."""
    return flat(pc.binary_join_element_wise(column, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary())))


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of some ``limit`` bytes; at least one row each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo = held = 0
    for row, n in enumerate(sizes):
        if held and held + n > limit:
            yield lo, row
            lo, held = row, 0
        held += int(n)
    if lo < len(column):
        yield lo, len(column)


def words(data: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of bytes in ``keep``."""
    inside = keep[data].view(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    return edges[0::2], edges[1::2]


def word_hashes(column: pa.Array, keep: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and the n + 1 offsets of the rows among them."""
    data, at = spaced(column)
    if lower:
        data = LOWER[data]
    starts, ends = words(data, keep)
    hashes = mix(stretch(prefix_hashes(data), starts, ends))
    return hashes, np.searchsorted(starts, at)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. (count of them) for every pair, in one array."""
    total = int(counts.sum())
    begin = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return begin + np.arange(total)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the half-open stretches."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
