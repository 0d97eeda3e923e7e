import random
import re

import pytest

from readwindows.llm import minhash
from readwindows.llm.components import components
from readwindows.session import stage

from helpers import plan_of

from .cases import DOCS, no_docs, odd_docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sets(rows, n):
    for doc, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        yield doc, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n):
    all_sets = list(sets(rows, n))
    parent = {d: d for d, _ in all_sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(d, s) for d, s in all_sets if d is not None and s]
    for i, (d, s) in enumerate(named):
        for e, t in named[i + 1 :]:
            if 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in all_sets), key=str)


def chain_rows():
    """Families in which each text is near the next one, far from the first; and a large one."""
    base = prose(9, 120).split()
    rows = [(100 + k, " ".join(base[2 * k : 2 * k + 60]), "en", "a", 0) for k in range(20)]
    big = prose(11, 80).split()
    for k in range(120):
        text = list(big)
        text[(7 * k) % 80] = f"new{k}"
        if k % 3 == 0:
            text[(11 * k + 5) % 80] = f"more{k}"
        rows.append((1000 + k, " ".join(text), "en", "a", 0))
    return rows


def test_equals_brute_force(spark):
    rows = odd_rows() + chain_rows()
    for n in (2, 5):
        docs = spark.createDataFrame(rows, DOCS)
        assert sorted(map(tuple, minhash.membership(docs, n).collect()), key=str) == brute(rows, n)


def below_threshold_rows(members: int) -> list[tuple]:
    """A large group of texts, nearly all pairs of which are a little less alike than the threshold."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(members):
        text = list(base)
        for place in rng.sample(range(0, 100, 2), 4):
            text[place] = f"x{k}y{place}"
        rows.append((5000 + k, " ".join(text), "en", "a", 0))
    return rows


@pytest.mark.parametrize("pairs_a_row", [0, 1])
def test_a_large_group_below_the_threshold(spark, monkeypatch, pairs_a_row):
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(minhash, "PAIRS_A_ROW", pairs_a_row)
    apart, emitted = minhash._apart, []

    def counted(postings, nodes, parts, percent, best):
        out = stage(apart(postings, nodes, parts, percent, best), "counted")
        emitted.append((best, out.where("b is not null").count(), out.where("token is not null").count()))
        return out

    monkeypatch.setattr(minhash, "_apart", counted)
    rows = below_threshold_rows(300) + chain_rows()
    assert sorted(map(tuple, minhash.membership(spark.createDataFrame(rows, DOCS), 2).collect()), key=str) == brute(rows, 2)
    (_, _, none), (_, pairs, blocks) = emitted
    # 300 * 299 / 2 pairs agree in most coordinates; a block gives one of them for every row, or its name.
    assert none == 0 and pairs < 300 * 5 * max(pairs_a_row, 1)
    assert pairs_a_row or (pairs == 0 and blocks > 0)


def test_keeps_one_of_each_component_with_all_columns(spark):
    docs = odd_docs(spark)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    expected = [r[0] for r in brute(odd_rows(), 5) if r[3]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    assert minhash.membership(no_docs(spark)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(50, k) for k in range(51, 60)] + [(7, 7), (61, 60), (60, 61)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 10 for k in range(10, 41)}, **{k: 50 for k in range(50, 60)}, 60: 60, 61: 60}


def test_stars_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr("readwindows.llm.components.stage", lambda df, name: written.append(name) or stage(df, name))
    stars = spark.createDataFrame([(k, k % 7) for k in range(7, 200)], "a long, b long")
    assert {tuple(r) for r in components(stars).collect()} == {(k, k % 7) for k in range(200)}
    assert len(written) == 1
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(60, 50), (60, 51), (51, 49)], "a long, b long")
    assert {tuple(r) for r in components(path).collect()} == {(k, 0) for k in range(41)} | {(k, 49) for k in (49, 50, 51, 60)}


def test_rows_go_to_one_class_of_sizes(spark, monkeypatch):
    """No row is doubled to be compared with the next class of sizes."""
    plans, write = {}, minhash.stage
    monkeypatch.setattr(minhash, "stage", lambda df, name="stage": (plans.setdefault(name, plan_of(df)), write(df, name))[1])
    minhash.membership(spark.createDataFrame(odd_rows() + chain_rows(), DOCS), 2)
    assert "explode(array(size" not in plans["postings"]
