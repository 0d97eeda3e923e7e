"""k-mers of nucleotide text, and their fixed integer vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from readwindows.functions.lets import let

# The alphabet in id order, and the two reserved ids before the k-mers.
ALPHABET = "ACGT"
PAD, PAD_ID = "<PAD>", 0
UNKNOWN, UNKNOWN_ID = "<UNK>", 1
FIRST_KMER_ID = 2

#: Bytes of text whose ids are made at a time; a longer sequence is taken alone.
BLOCK_BYTES = 1 << 21


def _letters(sequence: Column) -> Column:
    """Letters as an array; indexing it does not walk over the text."""
    return F.when(F.length(sequence) > 0, F.split(sequence, "")).otherwise(F.array().cast("array<string>"))


def _starts(letters: Column, k: int) -> Column:
    """0-based k-mer starts; empty when the sequence is shorter than k."""
    count = F.size(letters) - k
    return F.when(count >= 0, F.sequence(F.lit(0), count)).otherwise(F.array().cast("array<int>"))


def split(sequence: Column, k: int) -> Column:
    """All overlapping k-mers, in order."""

    def from_bytes(data: Column) -> Column:
        starts = F.when(F.length(data) >= k, F.sequence(F.lit(1), F.length(data) - (k - 1)))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.substring(data, i, F.lit(k)).cast("string"),
        )

    def from_letters(letters: Column) -> Column:
        return F.transform(_starts(letters, k), lambda i: F.array_join(F.slice(letters, i + 1, F.lit(k)), ""))

    single_bytes = F.octet_length(sequence) == F.length(sequence)
    return F.when(single_bytes, let(sequence.cast("binary"), from_bytes)).otherwise(
        let(_letters(sequence), from_letters)
    )


def text(sequence: Column, k: int) -> Column:
    """The k-mers joined by spaces."""
    return F.array_join(split(sequence, k), " ")


def _digit(letter: Column) -> Column:
    """0 to 3 for a letter of the alphabet, null for any other."""
    digit = F.when(letter == ALPHABET[0], F.lit(0))
    for value, known in enumerate(ALPHABET[1:], start=1):
        digit = digit.when(letter == known, F.lit(value))
    return digit


def _joined(left: Column, right: Column, at: int, width: int) -> Column:
    """Each number of ``left`` followed by the ``width``-digit number ``at`` places on."""
    return F.transform(left, lambda x, i: x * len(ALPHABET) ** width + F.get(right, i + at))


def _numbers(digits: Column, k: int) -> Column:
    """The k-digit number from each place on, by doubling; null where it meets a null or the end."""
    if k == 1:
        return digits

    def doubled(half: Column) -> Column:
        even = _joined(half, half, k // 2, k // 2)
        return even if k % 2 == 0 else _joined(even, digits, k - 1, 1)

    return let(_numbers(digits, k // 2), doubled)


_DIGITS = np.full(256, -1, np.int8)
_DIGITS[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))


def _packed(digits: np.ndarray, k: int) -> np.ndarray:
    """The number of two bits a letter of the ``k`` letters from each place on, by doubling."""
    if k == 1:
        return digits
    half = _packed(digits, k // 2)
    width = k // 2
    even = half[:-width] << (2 * width) | half[width:] if len(half) > width else half[:0]
    return even if k % 2 == 0 else even[: max(len(digits) - k + 1, 0)] << 2 | digits[k - 1 :]


def id_blocks(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-mer ids of the sequences of a batch, one behind the other, and how many each has: some rows at a time."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK_BYTES, side="right")) - 1)
        yield _block_ids(text[at[row] : at[end]], at[row : end + 1], k)
        row = end


def _block_ids(text: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int32 if len(ALPHABET) ** k + FIRST_KMER_ID < 2**31 else np.int64
    # A letter is a byte that doesn't continue another one.
    lead = (text & 0xC0) != 0x80
    at = at - at[0]
    if not lead.all():
        at = np.concatenate(([0], np.cumsum(lead)))[at]
        text = text[lead]
    digits = _DIGITS[text]
    places = max(len(digits) - k + 1, 0)
    wrong = np.concatenate(([0], np.cumsum(digits < 0, dtype=np.int32)))
    known = wrong[k:][:places] == wrong[:places]
    ids = np.where(known, _packed(digits.astype(kind) & 3, k)[:places] + kind(FIRST_KMER_ID), kind(UNKNOWN_ID))
    sizes = np.diff(at)
    counts = np.maximum(sizes - (k - 1), 0)
    # The last k - 1 places of a row reach into the next one.
    inside = np.arange(places) + k <= np.repeat(at[1:], sizes)[:places]
    return ids[inside], counts


def ids_of(column: pa.Array, k: int) -> pa.Array:
    """k-mer ids of all sequences of a batch."""
    kind = np.int32 if len(ALPHABET) ** k + FIRST_KMER_ID < 2**31 else np.int64
    blocks = list(id_blocks(column, k))
    ids = np.concatenate([np.zeros(0, kind), *(b[0] for b in blocks)])
    counts = np.concatenate([np.zeros(1, np.int64), *(b[1] for b in blocks)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(ids))


_KINDS = {"int": ArrayType(IntegerType()), "bigint": ArrayType(LongType())}


def encode(sequence: Column, k: int) -> Column:
    """k-mer ids: the k-mer read as a number in base four, after the reserved ids.

    A k-mer with any other letter (N, lower case) is unknown; null has none. A whole Arrow batch is packed at once,
    two bits a letter; ``encode_by_row`` gives the same without Python, some times slower.
    """
    kind = "int" if len(ALPHABET) ** k + FIRST_KMER_ID < 2**31 else "bigint"
    return F.arrow_udf(lambda column: ids_of(column, k), _KINDS[kind])(sequence)


def encode_by_row(sequence: Column, k: int) -> Column:
    """``encode`` as array transforms in each row, linear in the length, no lookup table."""
    kind = "int" if len(ALPHABET) ** k + FIRST_KMER_ID < 2**31 else "bigint"

    def ids(digits: Column) -> Column:
        complete = F.slice(_numbers(digits, k), F.lit(1), F.greatest(F.size(digits) - (k - 1), F.lit(0)))
        return F.transform(complete, lambda x: F.coalesce(x + FIRST_KMER_ID, F.lit(UNKNOWN_ID)))

    return let(F.transform(_letters(sequence), lambda c: _digit(c).cast(kind)), ids)


def nucleotides(sequence: Column, on_unknown: str = "error") -> Column:
    """One id per letter; any other letter is an error, or null with ``on_unknown='null'``."""
    if on_unknown not in ("error", "null"):
        raise ValueError(f"unknown policy: {on_unknown}")

    def coded(letter: Column) -> Column:
        if on_unknown == "null":
            return _digit(letter)
        error = F.raise_error(F.concat(F.lit("not a nucleotide: "), letter)).cast("int")
        return F.coalesce(_digit(letter), error)

    return F.transform(_letters(sequence), coded)


def pad(ids: Column, n: int) -> Column:
    """Exactly ``n`` ids: cut, or filled with the padding id."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD_ID), n)), 1, n)


def mask(ids: Column, n: int) -> Column:
    """1 for each real id of ``pad(ids, n)``, 0 for padding."""
    real = F.array_repeat(F.lit(1), F.least(F.size(ids), F.lit(n)))
    return F.concat(real, F.array_repeat(F.lit(0), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))


def effective_length(seq_len: Column, k: int) -> Column:
    """Number of k-mers of a sequence of ``seq_len`` letters, which is at least k."""
    return seq_len - k + 1


def spelled(index: Column, k: int) -> Column:
    """The ``index``-th of all k-mers in lexicographic order."""
    letters = [
        F.substring(F.lit(ALPHABET), (F.floor(index / 4 ** (k - 1 - j)) % 4 + 1).cast("int"), F.lit(1))
        for j in range(k)
    ]
    return F.concat(*letters)
