import math
import re
from collections import Counter

from helpers import plan_of
from readwindows.llm import mixing, search

from .cases import DOCS, labels, no_docs, odd_docs, odd_rows, prose


def levels(sizes):
    """Shares by weight with caps, the excess dealt again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.SOURCE_WEIGHTS[k % 3] for k, s in enumerate(names)}
    cap = {s: 2 * n for s, n in sizes.items()}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap[s]}
        if not over:
            out.update({s: weight[s] * level for s in free})
            break
        out.update({s: cap[s] for s in over})
        free -= over
    return out


def test_targets_and_taken(spark):
    rows = odd_rows() + [(100 + k, prose(k, 5 + k % 30), "en", "abc"[k % 3] if k % 7 else "hot", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, labels(spark)).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target = levels(size)
    assert len(got) == len(rows)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(size[s], round(target[s], 6)) for s in size})
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    for s in size:
        assert abs(taken[size[s]] - target[s]) <= 1
        epochs = int(target[s] // size[s]) if size[s] else 0
        assert all(r.taken >= epochs * r.size for r in got if r.source_size == size[s])
    again = mixing.mix(docs.orderBy("n_chars").repartition(5), labels(spark)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_better_documents_come_first(spark):
    rows = [(k, prose(k, 10), "en", "abcd"[k % 4], 0) for k in range(2000)]
    marks = labels(spark, [(k, k % 8 // 4, 0) for k in range(2000)])
    got = mixing.mix(spark.createDataFrame(rows, DOCS), marks).collect()
    extra = Counter()
    for r in got:
        part = r.taken - int(r.target // r.source_size) * r.size
        extra[r.doc_id % 8 // 4] += part
    assert extra[1] > 1.5 * extra[0]


def test_mixing_odd_rows(spark):
    assert mixing.mix(odd_docs(spark), labels(spark)).count() == len(odd_rows())
    assert mixing.mix(no_docs(spark), labels(spark)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, queries, k):
    docs = [(i, Counter(WORD.findall((t or "").lower()))) for i, t, *_ in rows if i is not None]
    n = len(docs)
    mean = sum(sum(c.values()) for _, c in docs) / n
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q, c in queries:
        scores = []
        for i, d in docs:
            size = sum(d.values())
            s = 0.0
            for w, m in c.items():
                if w in d:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    s += idf * (search.K3 + 1) * m / (m + search.K3) * d[w] * (search.K1 + 1) / (d[w] + search.K1 * (1 - search.B + search.B * size / mean))
            if s > 0:
                scores.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def test_search_equals_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] not in (3, 10)] + [(100 + k, prose(k, 8 + k % 40), "en", "a", 0) for k in range(250)] + [(900 + k, prose(77, 30), "en", "a", 0) for k in range(14)]
    docs = spark.createDataFrame(rows, DOCS)
    asked = [r for r in rows if r[0] is not None and r[0] % 50 in (0, 1, 4, 5)]
    queries = [(r[0], Counter(WORD.findall((r[1] or "").lower()))) for r in asked]
    for limit in (search.SHARD, 3000):
        search.SHARD, kept = limit, search.SHARD
        try:
            got = search.search(docs, spark.createDataFrame(asked, DOCS)).collect()
        finally:
            search.SHARD = kept
        expected = sorted(brute(rows, queries, search.K))
        got.sort(key=lambda r: (r.query_id, r.rank))
        assert [(r.query_id, r.rank, r.doc_id) for r in got] == [e[:3] for e in expected]
        assert all(abs(r.score - e[3]) < 1e-5 for r, e in zip(got, expected, strict=True))


def test_documents_that_leave_the_shards_do_not_grow_with_shards(spark, monkeypatch):
    rows = [(k, prose(k, 8 + k % 40), "en", "a", 0) for k in range(1200)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    asked = docs.where("doc_id % 50 = 0")
    whole = sorted(map(tuple, search.search(docs, asked).collect()))
    for name, value in {"SHARD": 2000, "LEAST_ROWS": 100, "LEVEL": 4, "SAMPLE_ROWS": 50}.items():
        monkeypatch.setattr(search, name, value)
    terms, n, mean = search.statistics(docs)
    queries = search.Queries(search.query_terms(asked, terms, n).toArrow())
    made = search._candidates(docs, queries, n, mean, search.K).groupBy("query_id").count().collect()
    assert len(made) == 24 and max(r["count"] for r in made) <= 4 * search.LEVEL * search.K < len(rows) // 4
    assert sorted(map(tuple, search.search(docs, asked).collect())) == whole
    expected = brute(rows, [(r[0], Counter(WORD.findall(r[1].lower()))) for r in rows if r[0] % 50 == 0], search.K)
    assert [r[:3] for r in whole] == [e[:3] for e in sorted(expected)]


def test_search_of_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    assert search.search(docs, docs).count() > 0
    assert search.search(no_docs(spark), docs).count() == 0
    assert search.search(docs, no_docs(spark)).count() == 0


def test_words_of_a_shard_are_counted_once_for_all_blocks_of_queries(spark, monkeypatch):
    rows = [(k, prose(k, 8 + k % 40), "en", "a", 0) for k in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    asked = docs.where("doc_id % 20 = 0")
    whole = search.search(docs, asked)
    for name, value in {"QUERY_POSTINGS": 100, "LEAST_ROWS": 100, "LEVEL": 4, "TOGETHER": 3, "ADDED": 200}.items():
        monkeypatch.setattr(search, name, value)
    found = search.search(docs, asked)
    assert plan_of(found).split("\n\n")[0].count("MapInArrow") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
