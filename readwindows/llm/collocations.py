"""Phrases whose words stand together more often than apart, from exact n-gram counts.

Texts become word codes once, a row per batch of some megabytes. A batch's words are dealt out in lists, one for each
shard of the dictionary, and come back as lists of ids: words that occur ``least`` times or more in their
language get dense ids; no candidate phrase can hold another one. All pairs of such words inside a piece are
packed into keys, permuted, and counted per batch in counting quotient filters, one for
each range of quotients (a shard). A shard's filters are merged by one task, and keys of at least ``least`` leave it;
counting loses nothing. Phrases of 3 to ``longest`` words are counted the same way, if all their pairs
are that frequent: no other one can be. Scores and the removal of parts are joins of these phrases with
each other.

Defined cases: null text has no words; null lang is ``und``; doc_ids don't matter, so repeated rows and null ids count
as rows of their own; equal scores and counts are ordered by phrase; an empty table and a language without candidates give
no rows; extra columns are ignored. A phrase of several languages is counted in each. More than 33 million words (of
all languages together) with ``least`` occurrences don't fit a key of 128 bits at ``longest=5`` and raise.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readwindows.llm import quotient
from readwindows.llm import text as T
from readwindows.session import stage

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text in a batch, and occurrences of phrases that a shard gets on average.
BATCH, SHARD = 4 << 20, 4_000_000
#: Words of batches that a shard of the dictionary gets on average.
ENTRIES = 1_000_000

#: Bytes between pieces, and bytes of words.
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?"]] = _BREAKS[0x0A:0x0E] = True
_WORD = ~_BREAKS
_WORD[[0x20, 0x09]] = False

_WORDS = pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))
_CODED = pa.schema([("batch", pa.int64()), ("codes", pa.binary()), ("words", _WORDS), ("entries", pa.int64())])
_KNOWN = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("codes", pa.binary()), ("ks", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("k", pa.int64())])


def _piece_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes from 1 of all words in order, with 0 between pieces; the words and how often each occurs."""
    joined = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    data = T.LOWER[T.flat(joined)[0]]
    starts, ends = T.words(data, _WORD)
    held = np.ascontiguousarray(data[_WORD[data]])
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.uint32) + np.uint32(1)
    counts = np.bincount(codes, minlength=len(words.dictionary) + 1)[1:]
    breaks = np.concatenate(([0], np.cumsum(_BREAKS[data])))
    parted = np.flatnonzero(breaks[starts[1:]] > breaks[ends[:-1]]) + 1
    return np.append(np.insert(codes, parted, 0), np.uint32(0)), words.dictionary, counts


def _coded(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """Per batch: its number, the codes of all its words, and what the codes stand for."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs, texts = batch.column(0), T.binary(batch.column(1))
            for lo, hi in T.pieces(texts, batch_bytes):
                codes, words, known = [], [], 0
                here = langs[lo:hi]
                for lang in here.unique():
                    made, names, counts = _piece_codes(texts[lo:hi].filter(pc.equal(here, lang)))
                    codes.append(np.where(made > 0, made + np.uint32(known), np.uint32(0)))
                    known += len(names)
                    names = pa.Array.from_buffers(pa.large_string(), len(names), names.buffers()).cast(pa.string())
                    words.append(pa.StructArray.from_arrays([pa.repeat(lang, len(names)), names, pa.array(counts, pa.int64())], names=["lang", "word", "n"]))
                words = pa.concat_arrays(words)
                listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                raw = np.concatenate(codes).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([raw], pa.binary()), listed.cast(_WORDS), pa.array([len(words)])], schema=_CODED)
                number += 1

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "batch long, codes binary, words array<struct<lang string, word string, n long>>, entries long")


def _dealt(coded: DataFrame, shards: int) -> DataFrame:
    """(batch, shard, codes, words): the words of each batch dealt out by their fingerprint, a row per shard."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("words")[row].values
                data, at = T.flat(words.field("word").cast(pa.large_binary()))
                shard = (T.mix(T.stretch(T.prefix_hashes(data), at[:-1], at[1:])) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
                codes = (order + 1).astype("<u4")
                listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(order)))
                raw = [codes[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"batch": pa.array([batch.column("batch")[row].as_py()] * len(raw), pa.int64()), "shard": pa.array(shard[order][cuts[:-1]]), "codes": pa.array(raw, pa.binary()), "words": listed})

    return coded.select("batch", "words").mapInArrow(run, "batch long, shard long, codes binary, words array<struct<lang string, word string, n long>>")


def _known(coded: DataFrame, shards: int, least: int) -> DataFrame:
    """What each shard of the dictionary knows, in rows of three kinds.

    (shard, lang, word, f, k): its words of at least ``least`` occurrences, numbered from 1; (shard, batch, codes, ks):
    which codes of a batch stand for these; (shard, lang, f): occurrences of all its words of a language.
    """

    def merged(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[:1]
        lists = rows.column("words").combine_chunks()
        words = lists.flatten()
        lang, word, n = (words.field(c) for c in ("lang", "word", "n"))
        # No word holds a space.
        names = pc.binary_join_element_wise(word, lang, " ").dictionary_encode()
        which, f = names.indices.to_numpy(), np.zeros(len(names.dictionary), np.int64)
        np.add.at(f, which, n.to_numpy())
        first = np.zeros(len(f), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        often = np.flatnonzero(f >= least)
        k = np.zeros(len(f), np.int64)
        k[often] = np.arange(1, len(often) + 1)
        langs = lang.dictionary_encode()
        of_lang = np.zeros(len(langs.dictionary), np.int64)
        np.add.at(of_lang, langs.indices.to_numpy(), n.to_numpy())
        mine, at = k[which], np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        batches, codes, ks = [], [], []
        for row, (number, raw) in enumerate(zip(rows.column("batch").to_pylist(), rows.column("codes"), strict=True)):
            here = mine[at[row] : at[row + 1]]
            if here.any():
                batches.append(number)
                codes.append(np.frombuffer(raw.as_buffer(), "<u4")[here > 0].tobytes())
                ks.append(here[here > 0].astype("<u4").tobytes())
        at = pa.array(first[often])
        parts = [
            {"lang": lang.take(at), "word": word.take(at), "f": pa.array(f[often]), "k": pa.array(k[often])},
            {"batch": pa.array(batches, pa.int64()), "codes": pa.array(codes, pa.binary()), "ks": pa.array(ks, pa.binary())},
            {"lang": langs.dictionary, "f": pa.array(of_lang)},
        ]
        tables = []
        for part in parts:
            size = len(next(iter(part.values())))
            part["shard"] = pa.array(np.full(size, shard[0].as_py()))
            tables.append(pa.table([part[c.name].cast(c.type) if c.name in part else pa.nulls(size, c.type) for c in _KNOWN], schema=_KNOWN))
        return pa.concat_tables(tables)

    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(coded, shards).repartition(max(parts, shards), "shard")
    return dealt.groupBy("shard").applyInArrow(merged, "shard long, batch long, codes binary, ks binary, lang string, word string, f long, k long")


def _dictionary(known: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(lang, word, f, id): dense ids from 1 for the frequent words; and how many lie in the shards before each shard."""
    often = known.where("word is not null")
    # A row per shard.
    sizes = {r.shard: r.n for r in often.groupBy("shard").agg(F.max("k").alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(sizes):
        before[shard] = total
        total += sizes[shard]
    offsets = known.sparkSession.createDataFrame([*before.items()], "shard long, before long")
    return often.join(F.broadcast(offsets), "shard").select("lang", "word", "f", (F.col("k") + F.col("before")).alias("id")), before


def _limbs(ids: np.ndarray, at: np.ndarray, length: int, longest: int, bits: int, width: quotient.Width) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the phrases of ``length`` ids that begin at ``at``: ids from the top, zeros behind."""
    high, low = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(length):
        value, shift = ids[at + k], (longest - 1 - k) * bits
        if shift >= width.low:
            high |= value << np.uint64(shift - width.low)
        else:
            low |= (value << np.uint64(shift)) & np.uint64((1 << width.low) - 1)
            if shift + bits > width.low:
                high |= value >> np.uint64(width.low - shift)
    return high, low


def _unpacked(high: np.ndarray, low: np.ndarray, longest: int, bits: int, width: quotient.Width) -> np.ndarray:
    """Rows of ids, zeros behind."""
    out = np.zeros((len(high), longest), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for k in range(longest):
        shift = (longest - 1 - k) * bits
        if shift >= width.low:
            out[:, k] = (high >> np.uint64(shift - width.low)) & mask
        else:
            out[:, k] = (low >> np.uint64(shift)) & mask
            if shift + bits > width.low:
                out[:, k] |= (high << np.uint64(width.low - shift)) & mask
    return out


def _with_ids(coded: DataFrame, known: DataFrame, before: dict[int, int]) -> DataFrame:
    """(batch, ids): ids of the frequent words in place of the codes, 0 for others."""
    held = known.where("batch is not null").groupBy("batch").agg(F.collect_list(F.struct("shard", "codes", "ks")).alias("held"))

    def run(rows):
        for batch in rows:
            for number, raw, held in zip(batch.column("batch"), batch.column("codes"), batch.column("held"), strict=True):
                codes = np.frombuffer(raw.as_buffer(), "<u4")
                table = np.zeros(int(codes.max(initial=0)) + 1, "<u4")
                for shard, mine, ks in zip(*(held.values.field(c) for c in ("shard", "codes", "ks")), strict=True):
                    table[np.frombuffer(mine.as_buffer(), "<u4")] = np.frombuffer(ks.as_buffer(), "<u4") + np.uint32(before[shard.as_py()])
                yield pa.RecordBatch.from_pydict({"batch": pa.array([number.as_py()], pa.int64()), "ids": pa.array([table[codes].tobytes()], pa.binary())})

    return coded.select("batch", "codes").join(held, "batch").mapInArrow(run, "batch long, ids binary")


def _prefix(occurrences: int, width: quotient.Width) -> int:
    """Bits of the shard's number."""
    return min(max(0, ceil(occurrences / SHARD) - 1).bit_length(), width.high)


def _counted(batches: DataFrame, keys, width: quotient.Width, prefix: int, bits: int, words: int, least: int) -> DataFrame:
    """Rows of (ids, f), the phrases of ``least`` or more, and of (batch, held), which of them a batch has.

    ``keys`` takes a row of ``batches`` and gives the upper and lower halves of its keys of ``words`` ids.
    """

    def run(rows):
        for batch in rows:
            for row in range(batch.num_rows):
                number = batch.column("batch")[row].as_py()
                high, low, counts = quotient.totals(*width.permute(*keys(batch, row)))
                shard = (high >> np.uint64(width.high - prefix)).astype(np.int64) if prefix else np.zeros(len(high), np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(high)] if len(high) else []
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    data = quotient.build(width, prefix, high[lo:hi], low[lo:hi], counts[lo:hi])
                    yield pa.RecordBatch.from_pydict({"batch": pa.array([number]), "shard": pa.array([shard[lo]]), "filter": pa.array([data], pa.binary())})

    out = pa.schema([("batch", pa.int64()), ("held", pa.binary()), ("ids", pa.list_(pa.int64())), ("f", pa.int64())])

    def merged(rows: pa.Table) -> pa.Table:
        top = rows.column("shard")[0].as_py()
        filters = [f.as_buffer() for f in rows.column("filter")]
        high, low, counts = quotient.merge(width, prefix, top, filters)
        often = counts >= least
        ids = _unpacked(*width.restore(high[often], low[often]), words, bits, width)
        sizes = (ids > 0).sum(axis=1)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids[ids > 0].astype(np.int64)))
        found = pa.table([pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary()), listed, pa.array(counts[often], pa.int64())], schema=out)
        if words > 2 or not len(ids):
            return found
        # Two ids fit 64 bits.
        whole = np.sort(high[often] << np.uint64(width.low) | low[often])
        numbers, held = [], []
        for number, data in zip(rows.column("batch").to_pylist(), filters, strict=True):
            mine = quotient.read(width, prefix, top, data)[:2]
            mine = mine[0] << np.uint64(width.low) | mine[1]
            mine = mine[whole[np.minimum(np.searchsorted(whole, mine), len(whole) - 1)] == mine]
            pair = width.restore(mine >> np.uint64(width.low), mine & np.uint64((1 << width.low) - 1))
            numbers.append(number)
            held.append((pair[0] << np.uint64(width.low) | pair[1]).astype("<u8").tobytes())
        lists = pa.table([pa.array(numbers, pa.int64()), pa.array(held, pa.binary()), pa.nulls(len(held), out.field("ids").type), pa.nulls(len(held), pa.int64())], schema=out)
        return pa.concat_tables([found, lists])

    filters = batches.mapInArrow(run, "batch long, shard long, filter binary")
    parts = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return filters.repartition(max(parts, 1 << prefix), "shard").groupBy("shard").applyInArrow(merged, "batch long, held binary, ids array<long>, f long")


def _phrases(batches: DataFrame, occurrences: int, words: int, least: int, longest: int) -> DataFrame:
    """(ids, f): phrases of 2 to ``longest`` ids with at least ``least`` occurrences.

    Pairs are counted first. A longer phrase can only be frequent if all its pairs are, so each batch gets
    back which of its pairs are frequent, and counts the longer phrases that consist of these.
    """
    bits = max(1, int(words).bit_length())
    if bits * max(longest, 2) > 128 or bits > 32:
        raise ValueError(f"{words} frequent words don't fit keys of 128 bits for phrases of {longest} words")
    narrow, width = quotient.Width(2 * bits), quotient.Width(bits * longest)

    def pairs(batch: pa.RecordBatch, row: int):
        ids = np.append(np.frombuffer(batch.column("ids")[row].as_buffer(), "<u4"), 0).astype(np.uint64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        return _limbs(ids, at, 2, 2, bits, narrow)

    def longer(batch: pa.RecordBatch, row: int):
        ids = np.append(np.frombuffer(batch.column("ids")[row].as_buffer(), "<u4"), [0] * longest).astype(np.uint64)
        held = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("held")[row].values]))
        pair = (ids[:-1] << np.uint64(bits)) | ids[1:]
        follows = held[np.minimum(np.searchsorted(held, pair), len(held) - 1)] == pair if len(held) else np.zeros(len(pair), bool)
        at, keys = np.flatnonzero(follows & (ids[:-1] > 0) & (ids[1:] > 0)), []
        for length in range(3, longest + 1):
            at = at[follows[at + length - 2] & (ids[at + length - 1] > 0)]
            keys.append(_limbs(ids, at, length, longest, bits, width))
        return tuple(np.concatenate(x) for x in zip(*keys, strict=True))

    two = stage(_counted(batches, pairs, narrow, _prefix(occurrences, narrow), bits, 2, least), "pairs")
    found = two.where("f is not null").select("ids", "f")
    if longest < 3:
        return found
    times = found.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0] * (longest - 2)
    held = two.where("held is not null").groupBy("batch").agg(F.collect_list("held").alias("held"))
    more = _counted(batches.join(held, "batch"), longer, width, _prefix(times, width), bits, longest, least)
    return found.unionByName(more.select("ids", "f"))


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, batch_bytes: int = BATCH) -> DataFrame:
    """(lang, words, f, n): words and phrases of up to ``longest`` words with ``least`` occurrences, and all words of the language."""
    coded = stage(_coded(docs, batch_bytes), "coded")
    entries = coded.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    shared = stage(_known(coded, ceil(entries / ENTRIES) or 1, least), "shared")
    sizes = stage(shared.where("word is null and batch is null").groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    often, before = _dictionary(shared)
    known = stage(often, "dictionary")
    words, occurrences = known.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    batches = stage(_with_ids(coded, shared, before), "ids")
    found = stage(_phrases(batches, occurrences, words, least, longest).withColumn("k", F.monotonically_increasing_id()), "phrases")
    named = found.select("k", F.posexplode("ids").alias("pos", "id")).join(known.select("id", "lang", "word"), "id")
    named = named.groupBy("k").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("at"))
    named = named.join(found.select("k", "f"), "k").select("lang", F.col("at.word").alias("words"), "f")
    return known.select("lang", F.array("word").alias("words"), "f").unionByName(named).join(sizes, "lang")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, batch_bytes: int = BATCH) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    all_ = stage(counts(docs, least, longest, batch_bytes).withColumn("phrase", F.array_join("words", " ")), "counts")
    known = all_.select("lang", "phrase", "f")
    found = all_.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.withColumn("first", F.array_join(F.expr("slice(words, 1, k)"), " ")).withColumn("rest", F.array_join(F.expr("slice(words, k + 1, size(words))"), " "))
    cut = cut.select("lang", "phrase", "a", "n", "k", "first", "rest")
    cut = cut.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    # 38 digits hold 1000 * a * n and l * r up to 10**17 words.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = (F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).cast("decimal(38,0)")
    cut = cut.withColumn("top", score).withColumn("bottom", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("top div bottom"))
    scored = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Parts of longer candidates, in order of place and length.
    part = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), p -> array_join(slice(words, p, m), ' '))))")
    inside = found.where(F.size("words") > 2).select("lang", F.explode(part).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    kept = kept.select("lang", "phrase", "a", "n", "best.score", "best.l", "best.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of every part of a language, then the best of these.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
