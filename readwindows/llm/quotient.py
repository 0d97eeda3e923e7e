"""Counting quotient filters that lose nothing: exact counts of fixed-width keys in few bits.

A key of ``bits`` bits is permuted by a Feistel network, which can be undone. Its top bits,
the quotient, aren't stored: a bitmap says which quotients occur and another one where each one's run
of keys ends. The rest of the key, the remainder, is stored whole, so two keys are never taken for each other. A
third bitmap marks the keys whose count is not one; only their counts are stored, 32 bits each
with room for larger ones.

A filter is built from sorted keys and read back sorted. ``merge`` adds up filters whose keys share a prefix: the top
``prefix`` bits of the permuted key, which deal keys out to shards and are in no filter.
Keys are pairs of unsigned 64-bit numbers: the upper ``bits // 2`` bits and the others.
"""

from __future__ import annotations

import numpy as np

_HEAD = np.dtype([("keys", "<u8"), ("quotient_bits", "<u4"), ("many", "<u4"), ("wide", "<u4")])
#: Fixed random odd multipliers of the rounds; an even number of them.
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_WIDE = 0xFFFFFFFF


class Width:
    """The permutation of keys of ``bits`` bits, at least 2 and at most 128."""

    def __init__(self, bits: int) -> None:
        self.bits, self.high = bits, bits // 2
        self.low = bits - self.high
        self._masks = [np.uint64((1 << b) - 1) for b in (self.high, self.low)]

    @staticmethod
    def _noise(x: np.ndarray, multiplier: int) -> np.ndarray:
        x = (x + np.uint64(1)) * np.uint64(multiplier)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(multiplier)
        return x ^ (x >> np.uint64(29))

    def permute(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = [high, low]
        for k, multiplier in enumerate(_ROUNDS):
            side = k % 2
            pair[side] = (pair[side] + self._noise(pair[1 - side], multiplier)) & self._masks[side]
        return pair[0], pair[1]

    def restore(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = [high, low]
        for k, multiplier in reversed(list(enumerate(_ROUNDS))):
            side = k % 2
            pair[side] = (pair[side] - self._noise(pair[1 - side], multiplier)) & self._masks[side]
        return pair[0], pair[1]


def totals(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts (of one each, if none are given)."""
    order = np.argsort(high)
    high, low = high[order], low[order]
    same = high[1:] == high[:-1]
    if (same & (low[1:] != low[:-1])).any():
        # Keys that agree in the upper half only.
        order = order[np.lexsort((low, high))]
        high, low = high[np.lexsort((low, high))], low[np.lexsort((low, high))]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    sums = np.diff(at, append=len(high)) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts
    return high[at], low[at], sums


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    """The lowest n bits of every value, a row each."""
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - n :] if n else np.zeros((len(values), 0), np.uint8)


def _numbers(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(bits), 64), np.uint8)
    padded[:, 64 - bits.shape[1] :] = bits
    return np.packbits(padded, axis=1).view(">u8").ravel().astype(np.uint64)


def build(width: Width, prefix: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of sorted distinct permuted keys that share their top ``prefix`` bits."""
    n = len(high)
    q = min(max(n.bit_length() - 1, 0), width.high - prefix)
    rest = width.high - prefix - q
    quotient = ((high >> np.uint64(rest)) & np.uint64((1 << q) - 1)).astype(np.int64)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotient] = 1
    ends = np.append(quotient[1:] != quotient[:-1], n > 0)
    remainders = np.hstack([_bits(high, rest), _bits(low, width.low)])
    many = counts != 1
    plain = np.minimum(counts[many], _WIDE).astype("<u4")
    wide = counts[counts >= _WIDE].astype("<u8")
    head = np.array([(n, q, len(plain), len(wide))], _HEAD)
    packed = (np.packbits(x).tobytes() for x in (occupied, ends, many, remainders.ravel()))
    return b"".join((head.tobytes(), *packed, plain.tobytes(), wide.tobytes()))


def read(width: Width, prefix: int, top: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted permuted keys and counts of a filter whose keys have the ``prefix`` top bits ``top``."""
    n, q, plain, wide = (int(x) for x in np.frombuffer(data, _HEAD, 1)[0])
    rest = width.high - prefix - q
    at = _HEAD.itemsize

    def take(bits: int) -> np.ndarray:
        nonlocal at
        size = -(-bits // 8)
        out = np.unpackbits(np.frombuffer(data, np.uint8, size, at))[:bits]
        at += size
        return out

    occupied, ends, many = take(1 << q), take(n), take(n).astype(bool)
    remainders = take(n * (rest + width.low)).reshape(n, -1)
    run = np.cumsum(ends, dtype=np.int64) - ends
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    quotient |= np.uint64(top << q)
    high = quotient << np.uint64(rest) | _numbers(remainders[:, :rest]) if rest < 64 else _numbers(remainders[:, :rest])
    low = _numbers(remainders[:, rest:])
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, "<u4", plain, at)
    counts[counts == _WIDE] = np.frombuffer(data, "<u8", wide, at + 4 * plain)
    return high, low, counts


def merge(width: Width, prefix: int, top: int, filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted permuted keys and counts of all filters together."""
    parts = [read(width, prefix, top, f) for f in filters]
    return totals(*(np.concatenate(x) for x in zip(*parts, strict=True)))
