"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags, each
with the tags and the class and id words above it. The field sees ancestors, lengths, links,
punctuation and typical words, and knows how content and boilerplate follow each other. It
is trained on labelled pages by gradient steps on the exact likelihood and decodes by Viterbi.

Without labelled pages, ``labelled_pages`` makes them from a bounded sample (``SAMPLE``): pages
whose markup names its parts (article, nav, footer ..) teach by these names, and the same texts
laid out in other ways, with side bars, notices, forms and comments, teach the rest.

Defined cases: null and empty html, and pages without content, give an empty text; broken,
nested and unclosed tags are read leniently, text after an unclosed ``<`` stays text; equal rows
give equal results; extra columns are ignored. Without any labelled page, everything is content.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 300
SLOTS = 1 << 14
EPOCHS, RATE, RIDGE, SEED = 6, 0.3, 1e-4, 8

#: Tags that begin a new block, tags whose text is never shown, tags without an end.
BLOCK_TAGS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("head script style title template noscript textarea svg iframe object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset(("script", "style", "textarea", "title"))
#: Tags that end an open one of the given kinds.
_CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_KEEPERS = frozenset("ul ol table dl select article section div main body nav aside footer header form blockquote".split())
_TYPICAL = tuple("cookie subscri advert sponsor comment reply replies share login sign newsletter copyright © privacy related menu search accept posted says".split())
_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.S)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PIECE = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    """The different words above a leaf block, its text, how many of its letters are links, and the two tags next above."""

    above: Collection[str]
    text: str
    linked: int = 0
    tags: tuple[str, ...] | None = None

    def nearest(self) -> tuple[str, ...]:
        return tuple(w for w in self.above if w[0] == "t")[-2:] if self.tags is None else self.tags


@dataclass(frozen=True)
class _Level:
    """An open tag. A level without new words shares the set of the level above, so deep nesting costs nothing."""

    tag: str
    words: frozenset[str]
    tags: tuple[str, ...]

    def below(self, tag: str, marks: list[str]) -> _Level:
        new = [w for w in (f"t:{tag}", *marks) if w not in self.words]
        return _Level(tag, self.words.union(new) if new else self.words, (*self.tags[-1:], f"t:{tag}"))


_ROOT = _Level("", frozenset(), ())


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order, character references decoded and white space joined."""
    out: list[Block] = []
    stack: list[_Level] = []
    open_tags: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []

    def close() -> None:
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            linked = sum(len(" ".join(t.split())) for t, link in held if link)
            top = stack[-1] if stack else _ROOT
            out.append(Block(top.words, text, min(linked, len(text)), top.tags))
        held.clear()

    def end(names: tuple[str, ...], stop: frozenset[str] = frozenset()) -> None:
        if not any(open_tags[t] for t in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                if any(level.tag in BLOCK_TAGS for level in stack[k:]):
                    close()
                open_tags.subtract(level.tag for level in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    at, n, hidden = 0, len(page), 0
    while at < n:
        tag = _TAG.search(page, at)
        upto = tag.start() if tag else n
        if upto > at and not any(open_tags[t] for t in HIDDEN_TAGS):
            held.append((html.unescape(page[at:upto]), open_tags["a"] > 0))
        if not tag:
            break
        at = tag.end()
        slash, name, rest = tag.group(1), (tag.group(2) or "").lower(), tag.group(3) or ""
        if not name:
            continue
        if slash:
            end((name,))
            continue
        if name == "br":
            held.append((" ", False))
            continue
        if name in BLOCK_TAGS:
            if name in _CLOSES:
                end(_CLOSES[name], _KEEPERS - {name})
            else:
                end(("p",), _KEEPERS)
            close()
        if name == "body":
            stack[:] = [s for s in stack if s.tag == "html"]
            open_tags = Counter(s.tag for s in stack)
        if name in VOID_TAGS or rest.endswith("/"):
            continue
        marks = (m for groups in _MARK.findall(rest) for m in groups if m) if "=" in rest else ()
        stack.append((stack[-1] if stack else _ROOT).below(name, [f"c:{w.lower()}" for m in marks for w in _PIECE.findall(m)]))
        open_tags[name] += 1
        if name in RAW_TAGS:
            found = re.compile(f"</{name}", re.I).search(page, at)
            at = found.start() if found else n
    close()
    return out


def _buckets(block: Block) -> Iterator[str]:
    text = block.text
    yield f"words:{min(text.count(' ') + 1, 64).bit_length()}"
    yield f"letters:{min(len(text), 2048).bit_length()}"
    yield f"links:{round(4 * block.linked / len(text))}"
    yield f"signs:{min(sum(map(text.count, '.,;:!?')), 8).bit_length()}"
    yield f"ends:{text[-1] in '.!?'}"
    yield f"upper:{text[:1].isupper()}"
    yield f"digits:{round(4 * sum(map(text.count, '0123456789')) / len(text))}"
    low = text.lower()
    for word in _TYPICAL:
        if word in low:
            yield f"word:{word}"


@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return crc32(name.encode()) % SLOTS


def features(found: list[Block]) -> list[np.ndarray]:
    """Slots of the binary features of every block."""
    out = []
    for k, block in enumerate(found):
        names = set(block.above)
        tags = block.nearest()
        names.add(f"own:{tags[-1] if tags else ''}")
        names.add(f"two:{'/'.join(tags[-2:])}")
        names.update(_buckets(block))
        names.add("first" if k == 0 else "last" if k == len(found) - 1 else "inner")
        out.append(np.array(list({_slot(x) for x in names})))
    return out


@dataclass
class Field:
    """Weights of content against boilerplate, and of the four label steps."""

    weights: np.ndarray
    steps: np.ndarray

    def potentials(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[r].sum()) for r in rows])

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi: the likeliest labels of the whole sequence."""
        if not found:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b, back = 0.0, 0.0, []
        for k, p in enumerate(self.potentials(features(found)).tolist()):
            if k == 0:
                a, b = 0.0, p
                continue
            from_a, from_b = b + s10 > a + s00, b + s11 > a + s01
            back.append((from_a, from_b))
            a, b = (b + s10 if from_a else a + s00), (b + s11 if from_b else a + s01) + p
        label = b > a
        labels = [label]
        for choice in reversed(back):
            label = choice[int(label)]
            labels.append(label)
        return labels[::-1]


def _marginals(p: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content for every block, and expected label steps (forward-backward)."""
    n = len(p)
    local = np.exp(np.clip(np.column_stack([np.zeros(n), p]), -30, 30))
    move = np.exp(np.clip(steps, -30, 30))
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    forward[0] = local[0] / local[0].sum()
    for k in range(1, n):
        f = (forward[k - 1] @ move) * local[k]
        forward[k] = f / f.sum()
    for k in range(n - 2, -1, -1):
        b = move @ (local[k + 1] * backward[k + 1])
        backward[k] = b / b.sum()
    both = forward * backward
    pairs = forward[:-1, :, None] * move * (local[1:] * backward[1:])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return both[:, 1] / both.sum(axis=1), pairs.sum(axis=0)


def fit(pages: list[tuple[list[Block], list[int]]]) -> Field:
    """Likelihood ascent with per-weight step sizes over labelled block sequences."""
    weights, steps = np.zeros(SLOTS), np.zeros((2, 2))
    seen_w, seen_s = np.full(SLOTS, 1e-2), np.full((2, 2), 1e-2)
    data = [(features(b), np.array(y)) for b, y in pages if b]
    if not data:
        weights[:] = 1.0
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            rows, y = data[k]
            p, pairs = _marginals(np.array([weights[r].sum() for r in rows]), steps)
            slots = np.concatenate(rows)
            pull = np.bincount(slots, np.repeat(y - p, [len(r) for r in rows]), minlength=SLOTS) - RIDGE * weights
            seen_w += pull**2
            weights += RATE * pull / np.sqrt(seen_w)
            real = np.zeros((2, 2))
            np.add.at(real, (y[:-1], y[1:]), 1)
            pull = real - pairs - RIDGE * steps
            seen_s += pull**2
            steps += RATE * pull / np.sqrt(seen_s)
    return Field(weights, steps)


#: Parts that the markup of a page may name. Content stands in the first, and in none of the others.
CONTENT_PARTS = ("t:article", "t:main")
OTHER_PARTS = ("t:nav", "t:footer", "t:header", "t:aside", "t:form", "t:menu", "t:button", "c:ad", "c:ads", "c:advert", "c:comment", "c:comments", "c:notice", "c:cookie", "c:sidebar", "c:banner", "c:menu", "c:promo", "c:share", "c:related")


def named(found: list[Block]) -> list[int] | None:
    """Labels by the names in the markup; None if it doesn't name where the content is."""
    labels = [int(any(w in CONTENT_PARTS for w in b.above) and not any(w in OTHER_PARTS for w in b.above)) for b in found]
    return labels if any(labels) else None


#: Layouts of made pages. Words above content; kinds of other parts, with words above and texts of their own.
_BODIES = (("t:div c:content", "t:p"), ("t:main", "t:p"), ("t:article c:post", "t:p"), ("t:div c:entry c:body", "t:div"), ("t:main t:article", "t:section t:p"), ("t:section c:story c:text", "t:p"), ("t:article", "t:blockquote t:p"), ("t:article", "t:ul t:li"), ("t:article", "t:h t:h2"))
_PARTS = (
    ("t:nav t:ul t:li t:a", "", 1.0), ("t:div c:menu t:ul t:li t:a", "", 1.0), ("t:header t:h1", "", 0.0), ("t:header t:div c:logo", "", 0.3), ("t:aside c:sidebar t:p", "Related", 0.4),
    ("t:div c:sidebar t:ul t:li t:a", "", 1.0), ("t:div c:ad", "", 0.0), ("t:div c:advert c:banner", "Sponsored", 0.5), ("t:div c:cookie c:notice t:p", "We use cookies. Accept", 0.1), ("t:div c:notice", "Subscribe to our newsletter", 0.2),
    ("t:form t:label", "Search", 0.0), ("t:form t:button", "Sign in", 0.0), ("t:section c:comments t:div c:comment t:p", "", 0.0), ("t:div c:comments t:ol t:li t:p", "says: reply", 0.1), ("t:article t:div c:comment t:p", "Posted reply", 0.0),
    ("t:footer", "© privacy", 0.2), ("t:div c:footer", "Copyright ©", 0.2), ("t:footer t:ul t:li t:a", "", 1.0), ("t:article t:aside t:p", "Related", 0.2), ("t:article t:div c:ad", "", 0.0), ("t:article t:nav t:a", "", 1.0), ("t:article t:form t:label", "Subscribe", 0.0),
    ("t:article t:footer", "Share", 0.2), ("t:article t:header t:div c:byline", "", 0.1), ("t:div c:share t:a", "Share", 1.0), ("t:div c:promo", "", 0.4),
)


def _made(rng: np.random.Generator, content: list[str], other: list[str]) -> tuple[list[Block], list[int]]:
    """The same texts in another layout: some parts, the content with some parts in it, more parts."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    page: list[Block] = []
    labels: list[int] = []

    def part(under: str = "") -> None:
        above, say, links = pick(_PARTS)
        above = f"{under} {above}".strip()
        for _ in range(int(rng.integers(1, 6))):
            # Comments and side bars read like articles: their text is from the same pages.
            text = pick(content) if rng.random() < 0.3 else pick(other)
            text = f"{say} {text}".strip() if rng.random() < 0.6 else text
            page.append(Block(("t:html", "t:body", *above.split(" ")), text, round(links * len(text))))
            labels.append(0)

    body, _ = pick(_BODIES)
    for _ in range(int(rng.integers(1, 4))):
        part()
    for k, text in enumerate(content):
        above = "t:h1" if k == 0 else pick([inner for b, inner in _BODIES if b == body] + ["t:p", "t:p", "t:p"])
        page.append(Block(("t:html", "t:body", *body.split(" "), *above.split(" ")), text, 0 if rng.random() < 0.9 else len(text) // 4))
        labels.append(1)
        if rng.random() < 0.12:
            part(body if rng.random() < 0.7 else "")
    for _ in range(int(rng.integers(1, 4))):
        part()
    return page, labels


def labelled_pages(pages: DataFrame) -> list[tuple[list[Block], list[int]]]:
    """Block sequences with labels: sampled pages as they are, and their texts in made layouts."""
    total = pages.count()
    share = min(1.0, SAMPLE / max(total, 1))
    rows = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col("html").cast("string").alias("h")).where("h is not null")
    out: list[tuple[list[Block], list[int]]] = []
    rng = np.random.default_rng(SEED)
    for row in rows.orderBy(F.xxhash64("h")).limit(2 * SAMPLE).collect():
        found = blocks(row.h)
        labels = named(found)
        if labels is None:
            continue
        out.append((found, labels))
        content = [b.text for b, y in zip(found, labels, strict=True) if y]
        other = [b.text for b, y in zip(found, labels, strict=True) if not y] or content
        out += [_made(rng, content[:40], other) for _ in range(3)]
    return out


def train(pages: DataFrame, labelled: list[tuple[list[Block], list[int]]] | None = None) -> Field:
    return fit(labelled_pages(pages) if labelled is None else labelled)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, y in zip(found, field.decode(found), strict=True) if y)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(h, sent.value) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
