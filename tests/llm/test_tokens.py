"""Simple-8b frames and the token files against plain encoding of whole texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readwindows.llm import simple8b, tokens
from . import cases

public = pytest.importorskip("public_tokenizers")

NUMBERS = st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(NUMBERS, max_size=300), st.integers(1, 9))
def test_frames_return_all_values(values, repeats):
    values = np.array(values * repeats, np.uint64)
    data = b"before" + simple8b.pack(values) + b"behind"
    assert simple8b.packed_size(data, 6) == len(data) - 12
    assert simple8b.unpack(data, 6).tolist() == values.tolist()
    for first in range(3):
        part = simple8b.unpack(data, 6, first, first + 2)
        assert part.tolist() == values[first * simple8b.BLOCK : (first + 2) * simple8b.BLOCK].tolist()


def test_runs_of_small_values_are_short():
    assert len(simple8b.pack(np.zeros(24_000, np.uint64))) < 24_000 / 20
    mixed = np.random.default_rng(1).integers(0, 1 << 15, 10_000).astype(np.uint64)
    assert len(simple8b.pack(mixed)) < 2.2 * len(mixed)


def expected(rows, vocabulary):
    """Plain encoding, document by document."""
    tokenizer = tokens._tokenizer(vocabulary)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = [
    "Don't  stop it's　we'll\tI'M\r\n1234 á ́a ̇ ệ",
    "a,'s b.'T c1's d'1s e''s f's,g 'll-'ll x'lly we'RE9've a'b'c 1a2b 3'd <| |> <p>it's</p> n≠́≠o,́",
    "x<|endoftext|>y <|startoftext|> z",
    "\x1c\x1d a\x85b   ​ ﬁn İstanbul ΣΑΣ Σ ΑΣ's",
    "日本語のテキスト 中文 한국어 مرحبا 😀😀👩‍👩‍👧",
    "a" * 20_000 + " " + "-" * 3000,
    "   ",
    "\x00 nul \x00\x00",
]


def test_whole_texts_give_the_same_ids(spark):
    vocabulary = public.path(tokens.VOCABULARY)
    rows = [(k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = tokens.round_trip(docs, vocabulary).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected(rows, vocabulary)


SIGNS = st.text(st.one_of(st.sampled_from("aAsStTlLdDvVrReEmM'’,.-=<>|1 \t\u0301\u0338\u00e9\u0130\u03a3\u2028"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(SIGNS, min_size=1, max_size=4))
def test_chunks_give_the_same_ids(texts):
    encoder = tokens.Encoder(public.path(tokens.VOCABULARY))
    ids, at = encoder(pa.array([t.encode() for t in texts], pa.large_binary()))
    plain = [[*tokens._tokenizer(public.path(tokens.VOCABULARY)).encode(t, add_special_tokens=False).ids, tokens.END] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == plain


@pytest.mark.parametrize("options", [{}, {"cut": False}, {"file_bytes": 3000, "frame_bytes": 500}])
def test_odd_rows(spark, options):
    vocabulary = public.path(tokens.VOCABULARY)
    docs = cases.odd_docs(spark).repartition(4)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    found = tokens.round_trip(docs, vocabulary, **options).orderBy("start").collect()
    assert [tuple(r) for r in found] == expected([(r.doc_id, r.text) for r in order], vocabulary)


def test_no_documents(spark):
    assert tokens.round_trip(cases.no_docs(spark), public.path(tokens.VOCABULARY)).collect() == []


def test_a_broken_file_raises():
    with pytest.raises(ValueError, match="no frame"):
        list(tokens.frames(b"something else than frames"))
