import hashlib
import re

from readwindows.llm import decontaminate as d

from .cases import odd_docs, odd_rows, no_docs, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window=13):
    out = []
    tests = [(i, words(t)) for i, t in items]
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for item, iw in tests:
            n = min(window, len(iw))
            grams = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    found |= {str(item)} - {"None"}
        names = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [(1, prose(2, 20)), (2, prose(2, 60)[30:200]), (10, "word"), (3, None), (None, prose(3, 40)), (4, "..."), (5, "ÉÀ über ñandú"), (6, prose(1, 400)), (6, prose(1, 400)), (7, prose(5, 30))]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force_in_one_block_and_in_many(spark):
    expected = brute(odd_rows(), ITEMS)
    for block in (d.BLOCK, 2000):
        got = d.contamination(odd_docs(spark), benchmark(spark), block=block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, got.collect()), key=str) == expected


def test_longest_matches_tell_both_places(spark):
    text = "before it " + prose(2, 20) + " after"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = d.longest_matches(docs, benchmark(spark, [(1, prose(2, 20))])).collect()
    assert [tuple(r) for r in found] == [(1, 2, "1", 0, 20)]


def test_removes_contaminated_rows_and_keeps_columns(spark):
    docs = odd_docs(spark)
    kept = d.decontaminate(docs, benchmark(spark))
    assert kept.columns == docs.columns
    clean = [r[0] for r in odd_rows() if not brute([r], ITEMS)[0][5]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    assert d.contamination(no_docs(spark), benchmark(spark)).count() == 0
    assert d.contamination(odd_docs(spark), benchmark(spark, [])).where("n_hit > 0").count() == 0
