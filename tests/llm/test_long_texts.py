"""Texts that used to take time in proportion to their square, and rules against plain definitions."""

import itertools
import random
import time

from readwindows.llm import extract, secrets, urlfilter


def seconds(function, *arguments):
    begun = time.time()
    result = function(*arguments)
    return result, time.time() - begun


def test_a_megabyte_of_hyphens():
    chain = "a-" * 500_000 + " = token=abcdef123 my_api_key: 'zz99yy88'"
    found, took = seconds(secrets.candidates, chain)
    assert [chain[a:b] for a, b in found][-2:] == ["abcdef123", "zz99yy88"] and took < 10
    for text in ("token" + " " * 1_000_000 + "x", "token=" + "=" * 1_000_000, "token token " * 80_000, "a_" * 500_000 + "=12345678"):
        assert seconds(secrets.candidates, text)[1] < 10


def test_nested_blocks():
    deep = 20_000
    page = "<html><body>" + "".join(f"<div class='c{k % 5}'>text {k} " for k in range(deep)) + "</p>" * deep
    found, took = seconds(lambda p: extract.features(extract.blocks(p)), page)
    assert len(found) == deep and took < 10
    inline = "<p>" + "<b><i class=x>word " * deep + "</u>" * deep + "<p>end"
    blocks, took = seconds(extract.blocks, inline)
    assert [b.text for b in blocks][-1] == "end" and took < 10


def test_words_above_a_block():
    (block,) = extract.blocks("<html><body><div class='main main'><p id=a-b>x</p></div>")
    assert set(block.above) == {"t:html", "t:body", "t:div", "c:main", "t:p", "c:a", "c:b"}
    assert block.nearest() == ("t:div", "t:p")


def test_rules_that_say_no_more_leave(spark):
    rng = random.Random(1)
    rules = []
    for n in (1, 2, 3, 4):
        for needed in itertools.combinations("abcdef", n):
            if rng.random() < 0.7:
                rules.append((list(needed), rng.choice(["allow", "block"]), rng.choice([0.8, 0.9, 1.0]), 0.01))
    df = spark.createDataFrame(rules, "needed array<string>, label string, confidence double, support double")
    known = {(tuple(n), label): c for n, label, c, _ in rules}

    def part_is_as_sure(needed, label, confidence):
        parts = (p for n in range(1, len(needed)) for p in itertools.combinations(needed, n))
        return any(known.get((p, label), -1) >= confidence for p in parts)

    expected = {(tuple(n), label) for n, label, c, _ in rules if not part_is_as_sure(n, label, c)}
    assert {(tuple(r.needed), r.label) for r in urlfilter.pruned(df).collect()} == expected and len(expected) < len(rules)
    index = urlfilter.Index([(tuple(n), label, c, s) for n, label, c, s in rules])
    for _ in range(200):
        found = rng.sample("abcdefg", rng.randint(0, 6))
        fitting = [k for k, r in enumerate(index.rules) if set(r[0]) <= set(found)]
        assert index.decide(found) == (min(fitting) if fitting else None)
        assert all(index.rules[k][2] >= index.rules[k + 1][2] for k in fitting[:-1])
