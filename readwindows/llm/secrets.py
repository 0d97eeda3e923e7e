"""Secret scan: patterns propose candidates, a random forest removes the false findings.

A candidate is a long run of key-like signs with a digit in it, or the value assigned to a name
such as ``password``. The forest (Spark ML) sees its length, its letter transitions against
those of the corpus, the part of it that dictionary words cover, how it looks, whether it
stands in a path, and the words beside it. Dictionary and transitions are counted over all
documents, whatever their number. The forest is trained on labelled findings; its nodes are
then read back as a table of a few thousand rows and sent to the tasks, so that texts are
scanned and masked where they are, without a shuffle.

Without a table of findings, ``labelled_findings`` makes one: candidates of a bounded sample of
the corpus, marked by their assignment, and for each some forms that are known to be
harmless (checksums in paths, placeholders, words, numbers) or secret (other keys, other names).

Defined cases: null and empty texts have no candidates, null texts stay null; rows are judged
one by one, so repeated and null ids don't matter; extra columns are passed on by ``mask`` and
ignored elsewhere; a corpus without candidates still trains on the made forms.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readwindows.session import scratch_path, stage

#: Texts of the corpus from which findings are labelled, in expectation; drawn by a hash of their id.
SAMPLE_TEXTS, SAMPLE_FINDINGS = 20_000, 4_000
#: A dictionary word's least share of the corpus's words, and its least and most letters.
DICTIONARY_SHARE, SHORTEST, LONGEST = 1e-6, 3, 12
TREES, DEPTH, SEED = 40, 8, 5
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Stands for every letter without case.
UNCASED = "\u00aa"
NEAR = 40

#: Names of secrets, and words beside strings that are none.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "credential", "bearer", "key")
PUBLIC_WORDS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "hash", "digest", "uuid", "guid", "example", "sample", "placeholder", "version", "build", "http", "https", "www", "isbn", "order", "phone")

_RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z0-9+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}")
_ASSIGNED = re.compile(r"(?i)(?:\b|(?<=[a-z0-9]_))(?:token|secret|password|passwd|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key)[\"']?\s*[:=]+\s*[\"']?([^\s\"',;|]{6,})")
_WORD = re.compile(r"[a-z0-9_\-]+")
_NAMES = ("length", "transitions", "coverage", "digits", "upper", "signs", "entropy", "hex", "classes", "in_path", "assigned", "quoted", "secret_words", "public_words", "repeats")
_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("secret", pa.bool_())])


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) in characters of all candidates, in order; of overlapping ones the longer."""
    if not text:
        return []
    found = [m.span() for m in _RUN.finditer(text)]
    if "=" in text or ":" in text:
        found += [m.span(1) for m in _ASSIGNED.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and start < out[-1][1]:
            if end - start > out[-1][1] - out[-1][0]:
                out[-1] = (start, end)
            continue
        out.append((start, end))
    return out


@dataclass
class Language:
    """What the corpus says about plain words: the common ones, and how letters follow each other."""

    words: frozenset[str]
    transitions: dict[str, float]
    floor: float

    def coverage(self, s: str) -> float:
        """Part of the letters inside dictionary words, longest first."""
        i = hit = 0
        while i < len(s):
            for n in range(min(LONGEST, len(s) - i), SHORTEST - 1, -1):
                if s[i : i + n] in self.words:
                    hit, i = hit + n, i + n
                    break
            else:
                i += 1
        return hit / max(len(s), 1)


def language(docs: DataFrame) -> Language:
    """Words of all documents that make up ``DICTIONARY_SHARE`` of all words or more, and the letter transitions of all words.

    The share bounds the dictionary by its inverse. Letters without case, as those of Han, Kana or Arabic, count as one
    letter (``_plain``), so transitions are bounded by the pairs of cased letters, of which there are some hundreds.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    counts = stage(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    least = DICTIONARY_SHARE * (counts.agg(F.sum("n")).first()[0] or 0)
    # ``coverage`` looks up 3 to 12 letters.
    known = counts.where(F.length("w").between(SHORTEST, LONGEST) & (F.col("n") >= F.lit(least))).select("w").collect()
    steps = F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substr(F.concat(F.lit("^"), "w", F.lit("$")), i, F.lit(2)))
    shapes = counts.select(F.regexp_replace("w", r"[\p{Lo}\p{Lm}]", UNCASED).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    pairs = {r.p: r.n for r in shapes.select(F.explode(steps).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()}
    total = sum(pairs.values()) + 1
    return Language(frozenset(r.w for r in known), {p: log(n / total) for p, n in pairs.items()}, log(0.5 / total))


def _plain(s: str) -> str:
    """Letters without case as one letter."""
    return s if s.isascii() else "".join(UNCASED if unicodedata.category(c) in ("Lo", "Lm") else c for c in s)


def features(text: str, start: int, end: int, lang: Language) -> list[float]:
    s = text[start:end]
    low, n = s.lower(), end - start
    shape = _plain(low)
    steps = [lang.transitions.get(a + b, lang.floor) for a, b in zip(shape, shape[1:])]
    counts = Counter(s)
    before, after = text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR].lower()
    near = _WORD.findall(before)[-4:] + _WORD.findall(after)[:3]
    classes = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return [
        float(min(n, 200)),
        sum(steps) / max(len(steps), 1),
        lang.coverage(low),
        sum(c.isdigit() for c in s) / n,
        sum(c.isupper() for c in s) / n,
        sum(not c.isalnum() for c in s) / n,
        -sum(c / n * log(c / n) for c in counts.values()),
        float(all(c in "0123456789abcdef" for c in low)),
        float(classes),
        float("/" in s or before[-1:] in ("/", "\\", ".") or after[:1] in ("/", "\\") or "://" in before[-30:].split(" ")[-1]),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"')),
        float(sum(w in SECRET_WORDS for w in near)),
        float(sum(w in PUBLIC_WORDS for w in near)),
        max(counts.values()) / n,
    ]


def _sampled(docs: DataFrame) -> DataFrame:
    total = docs.count()
    share = min(1.0, SAMPLE_TEXTS / max(total, 1))
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col("text").cast("string").alias("text")).where("text is not null")


def _made(rng: np.random.Generator, value: str, words: list[str]) -> list[tuple[str, str, int]]:
    """(context with ``%s``, value, label) of forms whose label is known."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = "".join(pick(signs) for _ in range(int(rng.integers(20, 44))))
    hexes = "".join(pick("0123456789abcdef") for _ in range(pick([32, 40, 64])))
    uuid = f"{hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:32]}"
    a, b = (pick(words) for _ in range(2))
    number = "".join(pick("0123456789") for _ in range(int(rng.integers(16, 20))))
    name, say = pick(SECRET_WORDS), pick(["%s = \"{}\"", "%s: {}", "%s='{}'", "\"%s\": \"{}\""])
    secret = say % name
    return [
        (f"{a} {secret.format('%s')} {b}", value, 1),
        (f"{a} {secret.format('%s')} {b}", made, 1),
        (f"{a} {secret.format('%s')} {b}", hexes, 1),
        (f"{a} {secret.format('%s').upper().replace('%S', '%s')} {b}", hexes.upper(), 1),
        (f"{a} %s {b}", f"AKIA{made[:16].upper()}", 1),
        (f"Authorization: Bearer %s {b}", made, 1),
        (f"{a} commit %s {b}", hexes, 0),
        (f"{a} sha256: %s {b}", hexes, 0),
        (f"{a} https://{b}.example.com/%s {a}", hexes, 0),
        (f"{a} /usr/share/{b}/%s.bin", hexes, 0),
        (f"{a} uuid %s {b}", uuid, 0),
        (f"{a} {secret.format('%s')} {b}", pick(["your_token_here_1", "xxxxxxxxxxxxxxxxxxxx1", "changeme", "example_key_1234567", "placeholder-value-0001", "<redacted>", "${TOKEN}"]), 0),
        (f"{a} %s {b}", number, 0),
        (f"{a} %s {b}", f"{a}{b}{pick(words)}{int(rng.integers(10, 99))}-{pick(words)}", 0),
        (f"{a} {secret.format('%s')} {b}", pick(words) + pick(words), 0),
        (f"{a} version %s {b}", f"{pick(words)}-{int(rng.integers(1, 30))}.{int(rng.integers(1, 30))}-{pick(words)}-x86_64".replace(".", "-"), 0),
    ]


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(text, start, end, label): candidates of the sample, by their assignment, and made forms."""
    spark = docs.sparkSession

    def cut(batches):
        for batch in batches:
            rows: dict[str, list] = {"text": [], "start": [], "end": [], "label": []}
            for text in batch.column(0).to_pylist():
                for start, end in candidates(text):
                    lo = max(0, start - 2 * NEAR)
                    piece = text[lo : end + 2 * NEAR]
                    plain = re.search(r"(?i)(token|secret|passw|pwd|key)\w*[\"']?\s*[:=]+\s*[\"']?$", text[max(0, start - NEAR) : start])
                    strong = end - start >= 20 and len(set(text[start:end])) >= 10
                    for column, value in zip(rows, (piece, start - lo, end - lo, int(bool(plain) and strong)), strict=True):
                        rows[column].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int64())]))

    schema = "text string, start long, end long, label long"
    found = _sampled(docs).mapInArrow(cut, schema).dropDuplicates(["text"]).orderBy(F.xxhash64("text")).limit(SAMPLE_FINDINGS).collect()
    rng = np.random.default_rng(SEED)
    words = sorted({w for r in found for w in re.findall(r"[a-z]{3,10}", r.text)})[:5000] or ["word", "other", "name"]
    values = [r.text[r.start : r.end] for r in found if r.label] or ["0123456789abcdef0123456789abcdef01234567"]
    rows = [tuple(r) for r in found]
    for k in range(300):
        for context, value, label in _made(rng, values[k % len(values)], words):
            at = context.index("%s")
            rows.append((context.replace("%s", value, 1), at, at + len(value), label))
    return spark.createDataFrame(rows, schema)


@dataclass
class Forest:
    """Nodes of all trees in flat arrays, and the language they were trained with."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    lang: Language

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, dtype=float).reshape(-1, len(_NAMES))
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                go_left = x[inner, f[inner]] <= self.threshold[at[inner]]
                at[inner] = np.where(go_left, self.left[at[inner]], self.right[at[inner]])
            total += self.value[at]
        return total / max(len(self.roots), 1)


def train(docs: DataFrame, findings: DataFrame | None = None) -> Forest:
    """A forest from labelled findings (text, start, end, label), by default those made from ``docs``."""
    spark = docs.sparkSession
    lang = language(docs)
    findings = labelled_findings(docs) if findings is None else findings
    sent = spark.sparkContext.broadcast(lang)

    def describe(batches):
        for batch in batches:
            rows = [features(t, s, e, sent.value) for t, s, e in zip(*(batch.column(k).to_pylist() for k in ("text", "start", "end")), strict=True)]
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "label": batch.column("label").cast(pa.float64())})

    table = findings.select("text", "start", "end", "label").mapInArrow(describe, "x array<double>, label double")
    table = table.select(array_to_vector("x").alias("features"), "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(table)
    return _nodes(spark, model, lang)


def _nodes(spark: SparkSession, model, lang: Language) -> Forest:
    """The fitted forest as arrays, through its saved form in the shared folder."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data*").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    place = {(r.treeID, r.id): i for i, r in enumerate(rows)}
    inner = [r.leftChild >= 0 for r in rows]
    shares = [list(r.impurityStats) for r in rows]
    return Forest(
        feature=np.array([r.split.featureIndex if i else -1 for r, i in zip(rows, inner, strict=True)]),
        threshold=np.array([r.split.leftCategoriesOrThreshold[0] if i else 0.0 for r, i in zip(rows, inner, strict=True)]),
        left=np.array([place[r.treeID, r.leftChild] if i else 0 for r, i in zip(rows, inner, strict=True)]),
        right=np.array([place[r.treeID, r.rightChild] if i else 0 for r, i in zip(rows, inner, strict=True)]),
        value=np.array([s[1] / max(sum(s), 1e-12) if len(s) > 1 else 0.0 for s in shares]),
        roots=np.array([place[t, 0] for t in sorted({r.treeID for r in rows})]),
        lang=lang,
    )


def _judged(texts: list[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    spans = [candidates(t or "") for t in texts]
    rows = [features(t, s, e, forest.lang) for t, found in zip(texts, spans, strict=True) for s, e in found]
    scores = iter(forest.scores(rows).tolist() if rows else [])
    return [[(s, e, next(scores)) for s, e in found] for found in spans]


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, score, secret): all candidates of all texts, in characters, and the forest's verdict."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            rows = []
            for i, found in zip(batch.column(0).to_pylist(), _judged(batch.column(1).to_pylist(), sent.value), strict=True):
                rows += [{"doc_id": i, "start": s, "end": e, "score": p, "secret": p >= threshold} for s, e, p in found]
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, end long, score double, secret boolean")


def mask(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MASK``; where a text changes, ``n_chars`` follows if there is one."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new, lengths = list(texts), batch.column(size).to_pylist() if size is not None else []
            for k, found in enumerate(_judged(texts, sent.value)):
                secret = [(s, e) for s, e, p in found if p >= threshold]
                if secret:
                    ends = [0, *(e for _, e in secret)]
                    new[k] = MASK.join(texts[k][lo:hi] for lo, hi in zip(ends, [*(s for s, _ in secret), len(texts[k])], strict=True))
                    if lengths:
                        lengths[k] = len(new[k])
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                columns[size] = pa.array(lengths, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
