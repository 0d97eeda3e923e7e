"""Simple-8b: a varying count of whole numbers in each 64-bit word, packed and unpacked in NumPy.

The top four bits of a word, its selector, say how many values of how many bits the other
sixty hold. Selector 0 is the escape: a value of more than thirty bits stands in a list of its own
and the word is its place holder. Values come in blocks of ``BLOCK``; no word holds values of two
blocks, and an offset per block says where its words begin, so any block can be read alone.

A frame is a header, the blocks' offsets and the words. ``pack`` makes one and ``unpack``
reads all of it or some blocks. Values are unsigned 64-bit numbers; an empty list is a frame
without blocks. All of a frame's numbers are little-endian.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the coding: values in a word and bits of each, by selector.
COUNT = np.array([1, 240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2])
BITS = np.array([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30])
#: A value of more than thirty bits has no selector left: it is an escape.
ESCAPE = 0
#: Least values that don't fit in each width, and which of the widths a selector has.
_WIDTHS = np.unique(BITS[1:])
_LIMITS = np.uint64(1) << _WIDTHS.astype(np.uint64)
_STEP = np.searchsorted(_WIDTHS, BITS)

HEADER = np.dtype([("values", "<u8"), ("words", "<u8"), ("escapes", "<u8")])


def _selectors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per value: the selector of a word that begins with it, and how many values that word takes."""
    n = len(values)
    blocks, most = -(-n // BLOCK), int(COUNT.max())
    # A row per block; beyond its end stand zeros, which always fit.
    needs = np.zeros((blocks, BLOCK + most), np.int8)
    flat = np.zeros(blocks * BLOCK, np.int8)
    flat[:n] = np.searchsorted(_LIMITS, values, side="right")
    needs[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    selector = np.zeros((blocks, BLOCK), np.int8)
    span, widest = 1, needs
    for s in range(15, 0, -1):
        # The largest need of the next COUNT[s] values, from that of the next ``span``.
        shift = int(COUNT[s]) - span
        while shift:
            part = min(shift, span)
            widest = np.maximum(widest[:, :-part], widest[:, part:])
            span, shift = span + part, shift - part
        selector[widest[:, :BLOCK] <= _STEP[s]] = s
    selector = selector.ravel()[:n]
    left = np.minimum(BLOCK, n - np.arange(0, n, BLOCK)).repeat(BLOCK)[:n] - np.arange(n) % BLOCK
    return selector, np.minimum(COUNT[selector], left)


def _heads(takes: np.ndarray) -> np.ndarray:
    """Which values begin a word: all blocks are walked side by side."""
    n = len(takes)
    head = np.zeros(n, bool)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        head[at] = True
        at = at + takes[at]
        on = at < ends
        at, ends = at[on], ends[on]
    return head


def pack(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, dtype=np.uint64)
    selector, takes = _selectors(values)
    at = np.flatnonzero(_heads(takes))
    selector, takes = selector[at], takes[at]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(3, 16):
        mine = np.flatnonzero(selector == s)
        for k in range(int(COUNT[s])):
            mine = mine[takes[mine] > k]
            words[mine] |= values[at[mine] + k] << np.uint64(k * BITS[s])
    escapes = values[at[selector == ESCAPE]]
    firsts = np.arange(0, len(values), BLOCK)
    offsets = np.searchsorted(at, firsts)
    escaped = np.searchsorted(at[selector == ESCAPE], firsts)
    header = np.array([(len(values), len(words), len(escapes))], HEADER)
    return b"".join(x.tobytes() for x in (header, offsets.astype("<u4"), escaped.astype("<u4"), words.astype("<u8"), escapes.astype("<u8")))


def packed_size(frame: bytes, at: int = 0) -> int:
    """Bytes of the frame that begins at ``at``."""
    values, words, escapes = (int(x) for x in np.frombuffer(frame, HEADER, 1, at)[0])
    return HEADER.itemsize + 8 * (-(-values // BLOCK) + words + escapes)


def unpack(frame: bytes, at: int = 0, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to ``last`` (not included) of the frame that begins at ``at``."""
    values, words, escapes = (int(x) for x in np.frombuffer(frame, HEADER, 1, at)[0])
    blocks = -(-values // BLOCK)
    at += HEADER.itemsize
    offsets = np.append(np.frombuffer(frame, "<u4", blocks, at), words).astype(np.int64)
    escaped = np.frombuffer(frame, "<u4", blocks, at + 4 * blocks)
    at += 8 * blocks
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint64)
    word = np.frombuffer(frame, "<u8", int(offsets[last] - offsets[first]), at + 8 * int(offsets[first]))
    selector = (word >> np.uint64(60)).astype(np.int64)
    # Where each word's values go: a block's last word may have room for more than are left.
    block = np.searchsorted(offsets[first : last + 1], np.arange(len(word)) + offsets[first], side="right") - 1
    before = np.concatenate(([0], np.cumsum(COUNT[selector])))
    start = before[:-1] - before[offsets[first:last] - offsets[first]][block] + block * BLOCK
    size = min(last * BLOCK, values) - first * BLOCK
    out = np.zeros(size + int(COUNT.max()), np.uint64)
    # A block's overhang holds zeros where the next block begins, so blocks must not overwrite each other.
    limit = np.minimum((block + 1) * BLOCK, size)
    for s in range(3, 16):
        mine = np.flatnonzero(selector == s)
        for k in range(int(COUNT[s])):
            mine = mine[start[mine] + k < limit[mine]]
            out[start[mine] + k] = word[mine] >> np.uint64(k * BITS[s]) & np.uint64((1 << int(BITS[s])) - 1)
    wide = np.flatnonzero(selector == ESCAPE)
    if len(wide):
        out[start[wide]] = np.frombuffer(frame, "<u8", len(wide), at + 8 * words + 8 * int(escaped[first]))
    return out[:size]
