"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a few megabytes of whole documents. Its suffix array orders the word suffixes
by their first ``window`` words; every benchmark suffix is found in it by binary search,
which gives all its occurrences. Only suffixes that begin with enough words of the
benchmark's own vocabulary are put into the array: no other one can match.

The benchmark travels to the tasks in blocks of about ``BLOCK`` bytes of text. Documents pass
one block after another, written in between, without any shuffle: a benchmark of any size is exact.

Defined cases: null and empty texts have no words; a benchmark row without words
finds nothing; the words of one with a null id are hit like others, but it is in no list of items; equal ids count once; rows of ``docs`` are judged one by one, so
repeated and null ids are kept; other columns are ignored. Empty tables give no rows, or
rows without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.llm import text as T
from readwindows.llm.frames import free_name
from readwindows.session import stage

WINDOW = 13
#: A document is contaminated if so many per cent of its words are hit.
SHARE_PERCENT = 5
BLOCK = 32 << 20

RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, spans array<struct<start: long, end: long>>"
)
MATCHES = "doc_id long, doc_start long, item_id string, item_start long, length long"
_RESULT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())]
    + [("contaminated", pa.bool_()), ("longest_match", pa.int64())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


class TestSuffixes:
    """The suffixes of one block of benchmark items, grouped by the words they must match."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        hashes, at = T.word_hashes(T.binary(pa.array([t for _, t in items], pa.string())), T.ALNUM)
        self.names = [name for name, _ in items]
        self.vocabulary = np.unique(hashes)
        self.words = np.searchsorted(self.vocabulary, hashes) + 1
        counts = np.diff(at)
        length = np.minimum(counts, window)
        item = np.flatnonzero(length > 0)
        per_item = counts[item] - length[item] + 1
        self.suffix = T.ranges(at[:-1][item], per_item)
        self.length = np.repeat(length[item], per_item)
        self.item = np.repeat(item, per_item)
        self.first = at[:-1][self.item]
        self.least = int(self.length.min()) if len(self.length) else 0
        self.depth = int(self.length.max()) if len(self.length) else 0
        self.groups = []
        for n in np.unique(self.length):
            rows = np.flatnonzero(self.length == n)
            keys, which = np.unique(_keys(self.words, self.suffix[rows], int(n)), return_inverse=True)
            order = np.argsort(which, kind="stable")
            ends = np.searchsorted(which[order], np.arange(len(keys) + 1))
            self.groups.append((int(n), keys, rows[order], ends))


def _keys(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The next ``depth`` word ids of each start as one comparable byte string."""
    out = np.empty((len(starts), depth), dtype=">u4")
    for k in range(depth):
        out[:, k] = ids[starts + k]
    return out.view(f"S{4 * depth}").ravel()


class Shard:
    """Word ids of some documents and the suffix array over them."""

    def __init__(self, column: pa.Array, tests: TestSuffixes):
        hashes, self.at = T.word_hashes(column, T.ALNUM)
        found = np.searchsorted(tests.vocabulary, hashes)
        found[found == len(tests.vocabulary)] = 0
        known = tests.vocabulary[found] == hashes if len(tests.vocabulary) else np.zeros(len(hashes), bool)
        ids = np.where(known, found + 1, 0)
        # A suffix ends with its document: one 0 behind each, no test word has that id.
        self.n_words = np.diff(self.at)
        self.base = self.at[:-1] + np.arange(len(self.n_words))
        self.ids = np.zeros(len(ids) + len(self.n_words) + tests.depth, dtype=np.uint32)
        self.ids[T.ranges(self.base, self.n_words)] = ids
        gaps = np.flatnonzero(self.ids == 0)
        until = np.diff(gaps, prepend=-1) - 1  # known words in a row before each gap
        starts = T.ranges(gaps - until, np.maximum(until - tests.least + 1, 0))
        keys = _keys(self.ids, starts, tests.depth) if tests.depth else np.zeros(0, "S1")
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = starts[order], keys[order]

    def search(self, tests: TestSuffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By binary search: word count, its distinct test strings, and for each the run [lo, hi) of suffixes."""
        width = 4 * tests.depth
        for n, keys, _, _ in tests.groups:
            pad = width - 4 * n
            low = keys.astype(f"S{width}")
            high = np.char.add(keys, b"\xff" * pad).astype(f"S{width}") if pad else low
            if pad:  # trailing zero bytes of a key are not stored, put them back before padding
                raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), 4 * n)
                high = np.hstack([raw, np.full((len(keys), pad), 255, np.uint8)]).copy().view(f"S{width}").ravel()
            yield n, keys, np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, positions, "right") - 1


def _hits(column: pa.Array, tests: TestSuffixes) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Per document: words, flat [start, end) pairs of the matched windows, and matched items."""
    shard = Shard(column, tests)
    docs = len(column)
    places: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    doc_items: list[np.ndarray] = []
    for (n, _, lo, hi), (_, _, rows, ends) in zip(shard.search(tests), tests.groups, strict=True):
        counts = hi - lo
        at = shard.suffixes[T.ranges(lo, counts)]
        string = np.repeat(np.arange(len(lo)), counts)
        places.append(at)
        lengths.append(np.full(len(at), n))
        pairs = np.unique(shard.document(at) * max(len(lo), 1) + string)
        doc, string = pairs // max(len(lo), 1), pairs % max(len(lo), 1)
        k = ends[string + 1] - ends[string]
        items = tests.item[rows[T.ranges(ends[string], k)]]
        doc_items.append(np.unique(np.repeat(doc, k) * max(len(tests.names), 1) + items))
    hits: list[list[int]] = [[] for _ in range(docs)]
    names: list[list[str]] = [[] for _ in range(docs)]
    if places and sum(map(len, places)):
        at, n = np.concatenate(places), np.concatenate(lengths)
        doc = shard.document(at)
        for d in np.unique(doc):
            mine = doc == d if docs == 1 else np.flatnonzero(doc == d)
            begin = at[mine] - shard.base[d]
            hits[d] = np.column_stack(_merged(begin, begin + n[mine])).ravel().tolist()
        for pair in np.unique(np.concatenate(doc_items)):
            name = tests.names[pair % len(tests.names)]
            if name is not None:
                names[pair // len(tests.names)].append(name)
    return shard.n_words, hits, names


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches; those that touch are joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return starts[new], ends[np.concatenate((new[1:], [len(starts)])) - 1]


def _blocks(benchmark: DataFrame, block: int) -> Iterator[Callable[[], list[tuple[str, str]]]]:
    """Readers of the items in lists of some ``block`` bytes of text, so that one list is in the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("t"))
    items = items.where("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("id"), F.lit(0)))).first()[0] or 0
    n = ceil(total / block) or 1
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == b)
        yield lambda part=part: [(r.id, r.t) for r in part.collect()]


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, block: int, finish, schema) -> DataFrame:
    """``docs`` past all blocks; ``finish`` turns the rows, their words, hits and items of the last one into the result."""
    spark = docs.sparkSession
    hits_name, items_name = free_name(docs, "hits"), free_name(docs, "items")
    out = docs.withColumns({hits_name: F.array().cast("array<long>"), items_name: F.array().cast("array<string>")})
    at = docs.columns.index("text")
    blocks = list(_blocks(benchmark, block))
    for k, items in enumerate(blocks):
        sent = spark.sparkContext.broadcast(TestSuffixes(items(), window))
        last = k == len(blocks) - 1

        def search(batches, sent=sent, last=last):
            for batch in batches:
                for lo, hi in T.pieces(batch.column(at)):
                    old = batch.slice(lo, hi - lo)
                    n_words, hits, names = _hits(T.binary(old.column(at)), sent.value)
                    *kept, held_hits, held_items = old.columns
                    hits = [a + b for a, b in zip(held_hits.to_pylist(), hits, strict=True)]
                    names = [a + b for a, b in zip(held_items.to_pylist(), names, strict=True)]
                    if last:
                        yield finish(pa.RecordBatch.from_arrays(kept, names=batch.schema.names[:-2]), n_words.tolist(), hits, names)
                    else:
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, held_hits.type), pa.array(names, held_items.type)], names=batch.schema.names)

        out = out.mapInArrow(search, schema if last else out.schema)
        if not last:  # one block's searchers at a time
            out = stage(out, "hits")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share_percent: int = SHARE_PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: words, hit words, items found, the verdict, and where the matches lie."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finish(rows, n_words, hits, names):
        ids = rows.column("doc_id").to_pylist()
        return pa.RecordBatch.from_pylist([_verdict(*row, share_percent) for row in zip(ids, n_words, hits, names, strict=True)], schema=_RESULT_ARROW)

    return _searched(narrow, benchmark, window, block, finish, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share_percent: int = SHARE_PERCENT, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, without a shuffle."""

    def finish(rows, n_words, hits, names):
        clean = [not _verdict(None, n, h, [], share_percent)["contaminated"] for n, h in zip(n_words, hits, strict=True)]
        return rows.filter(pa.array(clean, pa.bool_()))

    return _searched(docs, benchmark, window, block, finish, docs.schema)


def _verdict(doc_id: int | None, n_words: int, hits: list[int], items: list[str], share_percent: int) -> dict:
    pairs = np.array(hits, dtype=np.int64).reshape(-1, 2)
    begin, end = _merged(pairs[:, 0], pairs[:, 1]) if len(pairs) else (pairs[:, 0], pairs[:, 1])
    n_hit, names = int((end - begin).sum()), sorted(set(items))
    return {
        "doc_id": doc_id,
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": len(names),
        "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
        "contaminated": n_hit > 0 and 100 * n_hit >= share_percent * n_words,
        "longest_match": int((end - begin).max()) if len(begin) else 0,
        "spans": [{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)],
    }


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Every maximal verbatim match of at least ``window`` words (or a whole shorter item), with its place in both texts."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, block):
        sent = spark.sparkContext.broadcast(TestSuffixes(items(), window))

        def search(batches, sent=sent):
            for batch in batches:
                texts = T.binary(batch.column("text"))
                for lo, hi in T.pieces(texts):
                    yield _matches(texts[lo:hi], batch.column("doc_id")[lo:hi], sent.value)

        found = source.mapInArrow(search, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def _matches(column: pa.Array, ids: pa.Array, tests: TestSuffixes) -> pa.RecordBatch:
    shard = Shard(column, tests)
    suffix, place, length = [], [], []
    for (n, _, lo, hi), (_, _, rows, ends) in zip(shard.search(tests), tests.groups, strict=True):
        counts = hi - lo
        at, string = shard.suffixes[T.ranges(lo, counts)], np.repeat(np.arange(len(lo)), counts)
        k = ends[string + 1] - ends[string]
        suffix.append(rows[T.ranges(ends[string], k)])
        place.append(np.repeat(at, k))
        length.append(np.full(int(k.sum()), n))
    empty = np.zeros(0, np.int64)
    row, at, n = (np.concatenate(x or [empty]).astype(np.int64) for x in (suffix, place, length))
    # Windows that follow each other in both texts lie on one diagonal and make one longer match.
    diagonal = at - tests.suffix[row]
    order = np.lexsort((at, diagonal, tests.item[row] if len(row) else row))
    row, at, n, diagonal = row[order], at[order], n[order], diagonal[order]
    item = tests.item[row] if len(row) else row
    new = np.ones(len(row), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(row)])) - 1 if len(head) else head
    doc = shard.document(at[head])
    columns = [
        ids.take(pa.array(doc)).cast(pa.int64()),
        pa.array(at[head] - shard.base[doc] if len(head) else empty, pa.int64()),
        pa.array([tests.names[i] for i in item[head]], pa.string()),
        pa.array(tests.suffix[row[head]] - tests.first[row[head]] if len(head) else empty, pa.int64()),
        pa.array(at[tail] + n[tail] - at[head] if len(head) else empty, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_start", "item_id", "item_start", "length"])
