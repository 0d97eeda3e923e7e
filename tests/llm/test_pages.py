"""Archives and page texts."""

import base64
import hashlib

import numpy as np
import pytest

from readwindows.llm import extract, warc

FAKE = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\n tail WARC/1.0\r\n"
PAGES = "page_id long, url string, html string, digest string, p string, file string"


def rows():
    out = [(i, f"http://a/{i}", "é" * i * 50 + ("" if i % 3 else "p")) for i in range(40)]
    out += [(100, "u\r\nx", FAKE), (101, None, FAKE), (5, "z", FAKE * 30), (200, "q", None), (201, "q", ""), (None, "n", "same"), (7, "n2", "same"), (None, None, "only"), (300, "r", "rep"), (300, "r", "rep")]
    return out


def expected(data, least=0):
    first = {}
    coded = [(i, (h or "").encode()) for i, _, h in data]
    for i, raw in coded:
        if i is not None and len(raw) >= least:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, raw in coded:
        again = raw in first and i != first[raw]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip_in_small_byte_ranges(spark, least):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows()], PAGES)
        got = warc.round_trip(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got), key=str) == expected(rows(), least)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_a_cut_archive_raises(spark, tmp_path):
    path = str(tmp_path / "cut")
    warc.write(spark.createDataFrame([(1, "u", "a" * 300), (2, "v", "b" * 300)], "page_id long, url string, html string").coalesce(1), path)
    part = next(tmp_path.glob("cut/part-*"))
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.warc").write_bytes(part.read_bytes()[:-40])
    with pytest.raises(ValueError, match="chain"):
        warc.read(spark, str(other)).count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/x>Home<li><a href=/y>News</ul></nav><div class="cookie notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;text,   with
words.<br><p>It goes on, and on.</p><div class="ad">Buy now.</div><p>Second <i>part</i> of it tells, with 1 < 2, about more things. And goes on for a while.</p></article><aside class="sidebar">Other stories.</aside><section class="comments"><p>I liked it a lot, thanks.</p></section><footer>&copy; us</footer>"""


@pytest.fixture(scope="module")
def field(spark):
    made = []
    for k in range(60):
        body = "".join(f"<p>Line {j} of page {k}, it tells about things. And goes on for a while.</p>" for j in range(2 + k % 5))
        made.append((k, f"u{k}", f'<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News {k}</a></li></ul></nav><div class="ad">Buy {k} now.</div><article><h1>Page {k}</h1>{body}</article><footer>&copy; site</footer></body></html>'))
    return extract.train(spark.createDataFrame(made, "page_id long, url string, html string"))


def test_main_text_of_a_rich_page(field):
    assert extract.main_text(PAGE, field) == "Title & more First text, with words. It goes on, and on. Second part of it tells, with 1 < 2, about more things. And goes on for a while."


def test_blocks_are_lenient():
    assert [b.text for b in extract.blocks("a <b>b</i> c</b><p>d<div>e <3 f</div></p>g<!-- h --><style>i</style><br/>j<unclosed")] == ["a b c", "d", "e <3 f", "g j"]
    assert extract.blocks("") == [] and extract.blocks("<p></p> \n") == []


def test_marginals_and_viterbi_by_enumeration():
    rng = np.random.default_rng(1)
    p, steps = rng.normal(size=5), rng.normal(size=(2, 2))
    paths = {}
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        paths[tuple(y)] = np.exp(sum(p[k] for k in range(5) if y[k]) + sum(steps[a, b] for a, b in zip(y, y[1:])))
    total = sum(paths.values())
    both, pairs = extract._marginals(p, steps)
    assert np.allclose(both, [sum(v for y, v in paths.items() if y[k]) / total for k in range(5)])
    assert np.isclose(pairs[1, 0], sum(v * sum(a == 1 and b == 0 for a, b in zip(y, y[1:])) for y, v in paths.items()) / total)
    field = extract.Field(np.zeros(extract.SLOTS), steps)
    field.potentials = lambda rows: p
    found = [extract.Block(("t:p",), "x")] * 5
    assert tuple(int(x) for x in field.decode(found)) == max(paths, key=paths.get)


def test_extract_odd_pages(spark, field):
    data = [(1, None, None, "t"), (2, "u", "", "t"), (None, "u", PAGE, "t"), (3, "u", PAGE, "t"), (3, "u", PAGE, "t"), (4, "u", "<article>" + "<p>Word and more, as text goes. </p>" * 20_000, "t")]
    got = extract.extract(spark.createDataFrame(data, "page_id long, url string, html string, text string"), field).collect()
    assert len(got) == len(data) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert max(r.n_chars for r in got) > 500_000
