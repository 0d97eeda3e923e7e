"""Token ids of whole texts in binary files, and their way back.

A file is a row of frames in ascending order of doc_id, and the files follow each other by name. A
frame holds some documents: their number, doc_ids and sizes, then all their ids in the
Simple-8b coding of ``simple8b``, whose block offsets allow reading a part. One byte, the text
writer's line end, stands behind every frame. Files are written and read by Spark alone, so they may lie in any store,
and a lost task writes its file anew.

Texts are cut at ASCII white space, and between ASCII letters and other ASCII signs, before they reach the tokenizer, and
different chunks go through it once each while they are remembered: the tokenizer of ``VOCABULARY`` drops white space and lets no token cross these seams, so whole
texts give the same ids (the test compares them). ``cut=False`` gives whole texts to the tokenizer, for another vocabulary.

Defined cases: null and empty texts have the end id alone; rows of null id come first; rows of equal id stand
together, ordered by the fingerprints of their texts; a text of any length is one frame; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readwindows.llm import simple8b
from readwindows.llm import text as T
from readwindows.llm.frames import shards
from readwindows.session import scratch_path, stage

VOCABULARY = "word_bpe_49k.json"
END = 1
#: The vocabulary's mark of a word's end, and how many words go to the tokenizer as one text.
WORD_END, RUN = "</w>", 256
#: Bytes of text in a file, and in a frame.
FILE, FRAME = 16 << 20, 4 << 20
#: A Python worker remembers the words it meets until they are so many; no piece whose new words have more bytes than this on average.
KNOWN, LONGEST = 500_000, 48
#: Files whose totals are added up in one task of the first level.
FILES = 1024

#: The vocabulary's tokens are of letters, of one digit, of other signs, or an apostrophe with letters: none crosses the
#: seam of an ASCII letter (1) and another ASCII sign (2) but for the apostrophe (0), unless a special token, which begins so, is about.
_KINDS = np.zeros(256, np.int8)
_KINDS[:0x80] = 2
_KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = 1
_KINDS[[0x27, 0x20, *range(0x09, 0x0E)]] = 0
_MARK = b"<|"

MAGIC = 0x31423853
HEAD = np.dtype([("magic", "<u4"), ("docs", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("size", "<u8")])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    # Spark runs one task per core; threads of the tokenizer's own would only spin.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that no token crosses."""
    starts, ends = T.words(data, T.NON_SPACE)
    if _MARK in data.tobytes():
        return starts, ends
    kind = _KINDS[data]
    inner = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
    return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))


@lru_cache(maxsize=2)
def _last_tokens(path: str) -> np.ndarray:
    """Which ids end a word, by the vocabulary's own mark."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[k for token, k in vocabulary.items() if token.endswith(WORD_END)]] = True
    return out


class Encoder:
    """Ids of many texts; every different word is tokenized once while it is remembered."""

    def __init__(self, path: str, cut: bool = True) -> None:
        self._path, self._cut = path, cut
        self._known: dict[bytes, int] = {}
        self._ids, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        found = [f.ids for f in _tokenizer(self._path).encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, but words of ASCII letters go in runs, which is cheaper: their last tokens are marked in the vocabulary."""
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        rest = [k for k, w in enumerate(words) if not w.isalpha()]
        ids, _ = self._each([b" ".join([words[k] for k in plain[lo : lo + RUN]]) for lo in range(0, len(plain), RUN)])
        ends = np.flatnonzero(_last_tokens(self._path)[ids])
        if len(ends) != len(plain):
            return self._each(words)
        others, lengths = self._each([words[k] for k in rest])
        sizes = np.concatenate([np.diff(ends, prepend=-1), lengths])
        # Back to the order of the words.
        order = np.argsort(np.array(plain + rest, np.int64))
        starts = np.cumsum(sizes) - sizes
        return np.concatenate([ids, others])[T.ranges(starts[order], sizes[order])], sizes[order]

    def _of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for every word where its own begin among them and how many they are."""
        known = self._known
        slots = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        ids, sizes = self._encode([words[k] for k in new.tolist()])
        slots[new] = len(known) + np.arange(len(new))
        all_ids, all_sizes = np.concatenate([self._ids, ids]), np.concatenate([self._sizes, sizes])
        starts = np.cumsum(all_sizes) - all_sizes
        if len(known) < KNOWN and sum(len(words[k]) for k in new.tolist()) <= LONGEST * len(new):
            known.update((words[k], slot) for k, slot in zip(new.tolist(), slots[new].tolist(), strict=True))
            self._ids, self._sizes = all_ids, all_sizes
        return all_ids, starts[slots], all_sizes[slots]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id behind each, and the n + 1 offsets of the texts among them."""
        n = len(texts)
        end = np.array([END], np.uint32)
        if self._cut:
            data, rows = T.spaced(texts)
            starts, ends = _chunks(data)
            first = np.searchsorted(starts, rows)
            offsets = np.concatenate(([0], np.cumsum(ends - starts)))
            held = np.ascontiguousarray(data[T.NON_SPACE[data]])
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
            ids, starts, sizes = self._of_words(words.dictionary.to_pylist())
            index = words.indices.to_numpy().astype(np.int64)
        else:
            ids, sizes = self._each(texts.to_pylist())
            starts, first, index = np.cumsum(sizes) - sizes, np.arange(n + 1), np.arange(n)
        # The end id is one more word behind every text.
        index = np.insert(index, first[1:], len(starts))
        starts, sizes = np.append(starts, len(ids)), np.append(sizes, 1)
        before = np.concatenate(([0], np.cumsum(sizes[index])))
        return np.concatenate([ids, end])[T.ranges(starts[index], sizes[index])], before[first + np.arange(n + 1)]


@lru_cache(maxsize=2)
def _encoder(path: str, cut: bool) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path, cut)


def frame(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> bytes:
    docs = np.zeros(len(doc_ids), DOC)
    docs["doc_id"] = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    docs["null"] = doc_ids.is_null().to_numpy(zero_copy_only=False)
    docs["size"] = np.diff(at)
    return b"".join((np.array([(MAGIC, len(docs))], HEAD).tobytes(), docs.tobytes(), simple8b.pack(ids)))


def frames(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and ids of every frame of a file."""
    at = 0
    while at < len(data):
        magic, n = np.frombuffer(data, HEAD, 1, at)[0]
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        docs = np.frombuffer(data, DOC, int(n), at + HEAD.itemsize)
        at += HEAD.itemsize + docs.nbytes
        yield docs, simple8b.unpack(data, at)
        at += simple8b.packed_size(data, at) + 1


def write(docs: DataFrame, path: str, vocabulary: str, cut: bool = True, file_bytes: int = FILE, frame_bytes: int = FRAME) -> None:
    """Files of some ``file_bytes`` of text each; ``vocabulary`` is the path of the tokenizer's file on every executor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = shards(rows, "text", file_bytes)

    def run(batches):
        encoder = _encoder(vocabulary, cut)
        for batch in batches:
            texts = T.binary(batch.column(1))
            for lo, hi in T.pieces(texts, frame_bytes):
                data = frame(batch.column(0)[lo:hi], *encoder(texts[lo:hi]))
                column = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([column.cast(pa.string(), safe=False)], names=["value"])

    order = ["doc_id", "tie"]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(run, "value string").write.option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for docs, ids in frames(content.as_buffer().to_pybytes()):
                    sizes = docs["size"].astype(np.int64)
                    at = np.concatenate(([0], np.cumsum(sizes)))
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    columns = [pa.array([name] * len(docs)), pa.array(docs["doc_id"], mask=docs["null"] > 0), pa.array(at[:-1] + before), pa.array(sizes), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "inside", "n_tokens", "ids_crc32"])
                    before += int(at[-1])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = stage(files.mapInArrow(run, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long"), "directory")
    # Prefix sums over the files in two levels.
    total = found.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("no", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    total = total.withColumn("group", F.floor(F.col("no") / FILES))
    before = lambda value, order: F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = total.groupBy("group").agg(F.sum("n").alias("all")).withColumn("earlier", before("all", Window.orderBy("group")))
    total = total.withColumn("here", before("n", Window.partitionBy("group").orderBy("no"))).join(groups, "group")
    total = total.select("file", (F.col("here") + F.col("earlier")).alias("before"))
    return found.join(total, "file").select("doc_id", (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the ids of ``docs`` into the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, **options)
    return read(docs.sparkSession, path)
