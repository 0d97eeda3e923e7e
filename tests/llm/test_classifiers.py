"""Toxicity, secrets and url filters: held-out accuracy on small made corpora, and odd rows."""

import re
import tracemalloc
from collections import Counter
from math import log

import numpy as np
import pytest

from readwindows.llm import secrets, toxicity, urlfilter

from .cases import DOCS, WORDS, labels, no_docs, odd_docs, odd_rows, prose

INSULTS = ["vraxod", "quibzel", "zorgfit"]


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rows, marks = [], []
    for k in range(360):
        toxic = k % 6 == 0
        w = prose(1000 + k, 40).split()
        if toxic:
            w[k % 40], w[(k + 9) % 40] = INSULTS[k // 6 % 3], INSULTS[(k // 6 + 1) % 3]
        rows.append((k, " ".join(w), "en", "a", 0))
        marks.append((k, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), labels(spark, marks)


@pytest.fixture(scope="module")
def machine(toxic_corpus):
    return toxicity.train(*toxic_corpus)


def test_toxicity_on_held_out_texts(spark, toxic_corpus, machine):
    docs, marks = toxic_corpus
    rows = toxicity.score(docs, machine).join(marks, "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert len(rows) > 60
    assert sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in rows) >= 0.97 * len(rows)


def test_gaps_and_inserted_letters_are_tolerated(machine):
    for written in ("v.r.a.x.o.d", "vr-axod", "VRAXOD!!", "v r a x o d"):
        text = f"{prose(5, 10)} {written} {prose(6, 10)}"
        assert machine.probability(toxicity.text_margins([text], machine, {}))[0] >= 0.7, written
    assert machine.probability(toxicity.text_margins([prose(7, 30)], machine, {}))[0] < 0.5


def test_folded_weights_equal_the_kernel(machine):
    words = [WORDS[0], "vraxod", "v.raxod", "", "ab"]
    row, number, value = toxicity.features(words)
    norms = {r: sum(v * v for q, v in zip(row, value, strict=True) if q == r) for r in set(row.tolist())}
    assert all(abs(n - 1) < 1e-9 for n in norms.values())
    margins = machine.margins(words)
    for k in range(len(words)):
        plain = machine.offset + sum(v * machine.weights[c] for r, c, v in zip(row, number, value, strict=True) if r == k)
        assert abs(max(plain, machine.offset) - margins[k]) < 1e-5


def test_toxicity_of_odd_rows(spark, machine):
    docs = odd_docs(spark)
    scored = toxicity.score(docs, machine)
    assert scored.columns[:-1] == docs.columns
    rows = scored.select("doc_id", scored.columns[-1]).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r[1] <= 1 for r in rows)
    assert toxicity.keep_clean(docs, machine).columns == docs.columns
    assert toxicity.score(no_docs(spark), machine).count() == 0


def test_toxicity_without_usable_labels(spark):
    machine = toxicity.train(odd_docs(spark), labels(spark, [(1, None, None)]))
    assert {round(r.s, 6) for r in toxicity.score(spark.createDataFrame(odd_rows(), DOCS), machine).selectExpr("score as s").collect()} == {0.001}


@pytest.fixture(scope="module")
def forest(spark):
    rows = [(k, f'{prose(k, 20)} token = "{k * 7919 ** 9:040x}" {prose(k + 500, 20)} commit {k * 104729 ** 8:040x} end', "en", "a", 0) for k in range(1, 80)]
    return secrets.train(spark.createDataFrame([(i, t.replace("000000", "9f3a1c"), *r) for i, t, *r in rows], DOCS))


def test_secrets_are_told_from_look_alikes(forest):
    hexes = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    bad = [f'go token = "{hexes}" on', f"the password: Tr0ub4dor{hexes[:9]}Xz", f'API_KEY="{hexes[:32]}"']
    good = [f"see commit {hexes} there", f"at https://kara.example.com/{hexes} there", "number 4785380592391139 of", 'token = "your_token_here_1" or', prose(3, 200)]
    judged = secrets._judged(bad + good + [None, ""], forest)
    assert all(any(p >= 0.5 for _, _, p in found) for found in judged[: len(bad)])
    assert not any(p >= 0.5 for found in judged[len(bad) :] for _, _, p in found)


def test_masks_secrets_only(spark, forest):
    secret = '"0b96a8c8d79c4a5085c919698889f59b72ab7bb6"'
    rows = [*odd_rows(), (50, f"a token = {secret} b token = {secret}", "en", "a", 99)]
    docs = spark.createDataFrame(rows, DOCS)
    masked = secrets.mask(docs, forest)
    assert masked.columns == docs.columns
    got = {(r.doc_id, r.text, r.n_chars) for r in masked.collect()}
    new = 'a token = "[SECRET]" b token = "[SECRET]"'
    assert got == {(r[0], r[1], r[4]) for r in odd_rows()} | {(50, new, len(new))}
    found = [tuple(r)[:3] for r in secrets.scan(docs, forest).where("secret").collect()]
    assert sorted(found) == [(50, 11, 51), (50, 64, 104)]
    assert secrets.mask(odd_docs(spark), forest).count() == len(odd_rows())
    assert secrets.scan(no_docs(spark), forest).count() == 0


def test_language_counts_all_documents(spark, monkeypatch):
    rows = [(k, prose(k, 30), "en", "a", 0) for k in range(200)] + [(200, "Seltsam a " + "q" * 40, "xx", "z", 0), (None, "ébène 7x", None, None, None), (201, None, "en", "a", 0)]
    monkeypatch.setattr(secrets, "SAMPLE_TEXTS", 5)
    monkeypatch.setattr(secrets, "DICTIONARY", 10, raising=False)
    lang = secrets.language(spark.createDataFrame(rows, DOCS))
    words = [w for _, t, *_ in rows for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    pairs = Counter(a + b for w in words for a, b in zip(f"^{w}", f"{w}$", strict=True))
    total = sum(pairs.values()) + 1
    assert lang.words == {w for w in words if 3 <= len(w) <= 12} >= {"seltsam", "ébène"}
    assert lang.transitions == pytest.approx({p: log(n / total) for p, n in pairs.items()})
    assert lang.floor == pytest.approx(log(0.5 / total))


def test_dictionary_words_have_a_share_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(secrets, "DICTIONARY_SHARE", 0.1)
    lang = secrets.language(spark.createDataFrame([(1, "often " * 18 + "rare rarer", "en", "a", 0)], DOCS))
    assert lang.words == {"often"} and "ra" in lang.transitions
    assert secrets.language(no_docs(spark)).words == frozenset()


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, label string")


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


URLS = [None, "", "no url", "http://", "://x.org/", "https://Example.ORG/es/1", "https://example.org/en/12?x=1#y", "https://a.example.org/en/2", "http://notexample.org/es/", "http://x.com/de/?q", "http://x.com?de/", "http://x.net/fr/4#/de/", "http://com/fr/", "http://É.com/fr/é", "a://b://c.org/d", "http://x.org", "http://user@x.org:80/"]


def test_curated_rules_by_definition(spark):
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.judge(pages(spark, URLS + URLS)).collect()}
    for k, url in enumerate(URLS + URLS):
        host, path = plain_parts(url)
        fits = [h + p for _, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k] == (host, path, max(fits, key=len, default=None)), url


def test_mined_rules_equal_counting(spark):
    urls = [f"http://{h}.example.net/{p}/{k}" for k in range(30) for h in ("casino", "news") for p in ("win", "en")]
    from pyspark.sql import functions as F

    rows = urlfilter.parts(pages(spark, urls))
    labelled = rows.withColumn("label", F.when(rows.host.startswith("casino") & rows.path.startswith("/win"), "block").otherwise("allow"))
    index = urlfilter.mine(labelled)
    seen = labelled.select("label", urlfilter.tokens().alias("t")).collect()
    assert index.rules
    for needed, label, confidence, support in index.rules:
        held = [r.label for r in seen if set(needed) <= set(r.t)]
        assert abs(confidence - held.count(label) / len(held)) < 1e-9 and abs(support - held.count(label) / len(seen)) < 1e-9
        assert confidence >= urlfilter.CONFIDENCE
    test = ["http://www.casino.example.net/win/99", "http://news.example.net/win/99"]
    assert [r.verdict for r in urlfilter.judge(pages(spark, test), (), labelled).orderBy("page_id").collect()] == ["block", "allow"]


def test_url_filter_without_rows_or_labels(spark):
    assert urlfilter.judge(pages(spark, [None]).limit(0)).count() == 0
    assert [r.verdict for r in urlfilter.judge(pages(spark, ["http://x.net/a"])).collect()] == [urlfilter.DEFAULT]


def test_subsequences_are_listed_for_few_strings_at_a_time():
    words = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000]}" * 8 for k in range(3000)]
    machine = toxicity.Machine(np.ones(1 << 15), 0.5)
    tracemalloc.start()
    try:
        found = machine.margins(words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6
    assert found[::700].tolist() == [machine.margins([w])[0] for w in words[::700]]
