"""Global alignment similarity of two sequences.

With match 1 and free mismatches and gaps, the best global alignment score is the length
of the longest common subsequence. Spark has no such function, so it is an Arrow-batched
UDF. All pairs of a batch are worked on together: every letter of the longer sequence is a bit of
``uint64`` words, and one letter of the shorter ones is a few array operations on the words of
all pairs. With a bound, pairs that can't reach it any more leave the batch early.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: 64-bit words of the letters' positions that one group of pairs may take.
GROUP_WORDS = 1 << 20
#: Letters between two looks at which pairs can still reach their bound.
LOOK = 8
#: Pairs whose signatures are compared at once.
GROUP_PAIRS = 1 << 19


class Signed(NamedTuple):
    """Sequences under a key: ids, how many letters they have more than the key's size, and the words of their signatures."""

    key: np.ndarray
    id: np.ndarray
    more: np.ndarray
    words: list[np.ndarray]

    def take(self, rows: np.ndarray) -> Signed:
        return Signed(self.key[rows], self.id[rows], self.more[rows], [w[rows] for w in self.words])


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, int]:
    """A row of letter numbers per text, filled up with a number that no letter has, and that number."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    numbers = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
    numbers[flat] = 1
    letters = int(numbers.sum())
    numbers = np.cumsum(numbers, dtype=np.int32) - 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(sizes.max(initial=0))), letters, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = numbers[flat]
    return out, letters


def _group(longer: list[str], shorter: list[str], need: np.ndarray | None) -> np.ndarray:
    """Common lengths of pairs of similar size; -1 where less than ``need``."""
    n = len(longer)
    both, letters = _codes(longer + shorter)
    x, y = both[:n], np.ascontiguousarray(both[n:, : max(map(len, shorter), default=0)].T)
    words = max(1, -(-max(map(len, longer)) // 64))
    rows = np.arange(n)
    # By word, then letter, then pair.
    where = np.zeros((words, letters + 1, n), np.uint64)
    for place in range(x.shape[1]):
        where[place >> 6, x[:, place], rows] |= np.uint64(1 << (place & 63))
    where[:, letters] = 0
    where = where.reshape(words, -1)
    left = np.fromiter(map(len, shorter), np.int64, n)
    out = np.full(n, -1, np.int64)
    open_rows = np.full((words, n), ~np.uint64(0))
    for step in range(len(y)):
        at = (y[step] if len(rows) == n else y[step, rows]) * np.int64(n) + rows
        carry = None
        for word in range(words):
            mine = open_rows[word]
            hit = mine & where[word].take(at)
            total = mine + hit
            over = total < hit
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64) if word + 1 < words else None
            np.bitwise_xor(mine, hit, out=mine)
            np.bitwise_or(mine, total, out=mine)
        if need is not None and step % LOOK == LOOK - 1:
            found = 64 * words - np.bitwise_count(open_rows).sum(axis=0, dtype=np.int64)
            alive = found + np.maximum(left[rows] - step - 1, 0) >= need[rows]
            if alive.mean() < 0.75:
                rows, open_rows = rows[alive], np.ascontiguousarray(open_rows[:, alive])
                if not len(rows):
                    return out
    out[rows] = 64 * words - np.bitwise_count(open_rows).sum(axis=0, dtype=np.int64)
    return out if need is None else np.where(out >= need, out, -1)


def lcs_lengths(a: Sequence[str], b: Sequence[str], need: np.ndarray | None = None) -> np.ndarray:
    """Length of the longest common subsequence of every pair.

    ``need`` names the least length of interest for each pair; the result is -1 where it isn't reached.
    """
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    sizes = np.array([(len(x), len(y)) for x, y in pairs], np.int64).reshape(-1, 2)
    out = np.zeros(len(pairs), np.int64)
    order = np.lexsort((sizes[:, 1], -(-sizes[:, 0] // 64)))
    lo = 0
    while lo < len(order):
        # Pairs of as many words; the letters of a group are at most some hundreds in practice.
        words = max(1, -(-int(sizes[order[lo], 0]) // 64))
        hi = int(np.searchsorted(-(-sizes[order, 0] // 64), words, side="right"))
        hi = max(lo + 1, min(hi, lo + max(64, GROUP_WORDS // (words * 32))))
        group = order[lo:hi]
        longer, shorter = ([pairs[k][side] for k in group] for side in (0, 1))
        out[group] = _group(longer, shorter, None if need is None else need[group])
        lo = hi
    return out


#: Bits of a signature that one letter more or less can change: it breaks up to two runs of three letters and makes three, or the reverse.
BITS_PER_LETTER = 5


def run_signatures(texts: Sequence[str]) -> np.ndarray:
    """Which of 64 kinds of runs of three letters occur in each text, as the bits of a number."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") >> 1 & 3).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(row[2:] == row[:-2])
    kinds = letters[inside] << 4 | letters[inside + 1] << 2 | letters[inside + 2]
    seen = np.zeros((len(texts), 64), np.uint8)
    seen[row[inside], kinds] = 1
    return np.packbits(seen, axis=1, bitorder="little").view("<i8").ravel()


#: The same of runs of four letters: one letter breaks up to three and makes four.
BITS_PER_LETTER_OF_FOUR = 7
WORDS = ("w0", "w1", "w2", "w3")


def four_signatures(texts: Sequence[str]) -> np.ndarray:
    """Which of 256 kinds of runs of four letters occur in each text, as the bits of four numbers."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") >> 1 & 3).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(row[3:] == row[:-3])
    kinds = letters[inside] << 6 | letters[inside + 1] << 4 | letters[inside + 2] << 2 | letters[inside + 3]
    seen = np.zeros((len(texts), 256), np.uint8)
    seen[row[inside], kinds] = 1
    return np.packbits(seen, axis=1, bitorder="little").view("<i8")


def like_pairs(x: Signed, y: Signed, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids in ``x`` and ``y`` of all pairs with one key whose signatures differ no more than ``edits`` letters allow.

    Pairs of equal size, which meet both ways, are looked at once.
    """
    keys, ids = np.unique(x.key), np.unique(np.concatenate((x.id, y.id)))
    places = [np.searchsorted(keys, side.key) * (len(ids) + 1) + np.searchsorted(ids, side.id) for side in (x, y)]
    order = np.argsort(places[0])
    x, place = x.take(order), places[0][order]
    y = y.take(known := np.flatnonzero(keys[np.minimum(np.searchsorted(keys, y.key), len(keys) - 1)] == y.key) if len(keys) else np.zeros(0, np.int64))
    at = places[1][known]
    group = at // (len(ids) + 1) * (len(ids) + 1)
    first = np.where(y.more > 0, np.searchsorted(place, group), np.searchsorted(place, at, "right"))
    count = np.searchsorted(place, group + len(ids)) - first
    most = (BITS_PER_LETTER_OF_FOUR * (2 * edits - y.more.astype(np.int64))).astype(np.uint16)  # of letters that the common subsequence may leave out
    ends = np.cumsum(count)
    lo = 0
    while lo < len(known):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + GROUP_PAIRS, "right")))
        size = count[lo:hi]
        a = np.arange(int(ends[hi - 1] - before)) + np.repeat(first[lo:hi] - (ends[lo:hi] - size - before), size)
        differ = np.zeros(len(a), np.uint16)
        for mine, other in zip(x.words, y.words, strict=True):
            differ += np.bitwise_count(mine[a] ^ np.repeat(other[lo:hi], size))
        near = np.flatnonzero(differ <= np.repeat(most[lo:hi], size))
        b = lo + np.searchsorted(ends[lo:hi] - before, near, "right")
        yield x.id[a[near]], y.id[b]
        lo = hi


@F.pandas_udf(StructType([StructField(w, LongType()) for w in WORDS]))
def four_signature(texts: pd.Series) -> pd.DataFrame:
    """``four_signatures`` of a column without nulls."""
    return pd.DataFrame(four_signatures(texts.tolist()), columns=list(WORDS))


@F.pandas_udf(LongType())
def run_signature(texts: pd.Series) -> pd.Series:
    """``run_signatures`` of a column without nulls."""
    return pd.Series(run_signatures(texts.tolist()), dtype=np.int64)


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(a.tolist(), b.tolist()), dtype=np.int32)


def similarity(a: Column, b: Column) -> Column:
    """Alignment score over the longer length; null when both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return _lcs(a, b) / F.nullif(longest, F.lit(0))


@F.pandas_udf(IntegerType())
def _lcs_from(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(a.tolist(), b.tolist(), need.to_numpy(np.int64)), dtype=np.int32)


def common_letters(a: Column, b: Column, need: Column) -> Column:
    """Length of the longest common subsequence, or -1 where it is less than ``need``."""
    return _lcs_from(a, b, need.cast("int"))
