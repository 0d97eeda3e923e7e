"""Counting quotient filters, and phrases against a plain count."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readwindows.llm import collocations, quotient
from . import cases

A_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([2, 5, 20, 63, 64, 65, 85, 127, 128]), st.lists(st.tuples(st.integers(0, 2**128 - 1), st.sampled_from([1, 2, 2**32, 2**40])), max_size=60), st.integers(0, 4))
def test_filters_lose_nothing(bits, keys, prefix):
    width = quotient.Width(bits)
    prefix = min(prefix, width.high)
    keys = [(k % (1 << bits), n) for k, n in keys]
    expected = collections.Counter()
    for k, n in keys:
        expected[k] += 2 * n
    high = np.array([k >> width.low for k, _ in keys], np.uint64)
    low = np.array([k & ((1 << width.low) - 1) for k, _ in keys], np.uint64)
    high, low, counts = quotient.totals(*width.permute(high, low), np.array([n for _, n in keys], np.int64))
    top = np.array([int(h) >> (width.high - prefix) for h in high], int)
    found = {}
    for t in set(top.tolist()):
        data = quotient.build(width, prefix, high[top == t], low[top == t], counts[top == t])
        h, l, n = quotient.merge(width, prefix, t, [data, data])
        assert (np.diff(h.astype(object)) >= 0).all()
        h, l = width.restore(h, l)
        found |= {(int(a) << width.low) | int(b): int(c) for a, b, c in zip(h, l, n, strict=True)}
    assert found == dict(expected)


def plain(rows, least, longest=5, top=2000):
    """All steps on lists and dictionaries."""
    counts, sizes = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(A_Z)):
            words = re.findall(r"[^ \t]+", piece)
            sizes[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[p : p + m])) for p in range(len(words) - m + 1))
    known = {k: f for k, f in counts.items() if f >= least}
    dropped = set()
    for (lang, w), f in known.items():
        for m in range(2, len(w)):
            dropped |= {(lang, w[p : p + m]) for p in range(len(w) - m + 1) if 100 * f >= 100 * known[lang, w[p : p + m]]}
    out = collections.defaultdict(list)
    for (lang, w), a in known.items():
        if len(w) > 1 and (lang, w) not in dropped:
            n = sizes[lang]
            score, _, l, r = min((1000 * a * n // (known[lang, w[:k]] * known[lang, w[k:]]), k, known[lang, w[:k]], known[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r, n))
    return {(lang, rank, p.decode(), -a, l, r, n, -s) for lang, found in out.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(found)[:top], 1)}


def found(docs, **options):
    rows = [tuple(r) for r in collocations.collocations(docs, **options).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("options", [{"least": 3}, {"least": 3, "top": 4}, {"least": 2, "longest": 3, "batch_bytes": 900}])
def test_phrases_by_definition(spark, options, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 300)
    rows = [(("en", "fr", None, "und")[k % 4], cases.prose(k % 7, 60) + "! New York, new\tYork; NEW york: Été\x0bété " + "so it goes " * 3) for k in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    expected = plain(rows, **{k: v for k, v in options.items() if k != "batch_bytes"})
    assert found(docs, **options) == expected and len(expected) > 10


def test_odd_rows(spark):
    docs = cases.odd_docs(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(docs, least=2) == plain(rows, 2)


def test_no_phrases(spark):
    assert found(cases.no_docs(spark)) == set()
    assert found(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")) == set()


def test_words_of_batches_travel_as_lists(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ENTRIES", 400)
    rows = [(("en", None)[k % 2], cases.prose(k, 60) + " so it goes") for k in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    coded = collocations._coded(docs, 500).cache()
    batches, entries = coded.count(), coded.agg({"entries": "sum"}).first()[0]
    shards = -(-entries // collocations.ENTRIES)
    shared = collocations._known(coded, shards, 2).cache()
    sent = shared.where("batch is not null").count()
    assert shards > 2 and batches <= sent <= batches * shards < entries / 4
    often, before = collocations._dictionary(shared)
    often = often.collect()
    counts = collections.Counter((lang or "und", w) for lang, text in rows for w in re.findall(r"[^ \t.,;:!?\n-\r]+", text.translate(A_Z)))
    assert {(r.lang, r.word): r.f for r in often} == {k: f for k, f in counts.items() if f >= 2}
    assert sorted(r.id for r in often) == list(range(1, len(often) + 1)) and len(before) <= shards
    assert found(docs, least=2, batch_bytes=500) == plain(rows, 2)
