"""Toxicity by a support vector machine with a gap-weighted subsequence kernel.

Two strings are alike by the subsequences of three letters they share, each weighted by
``DECAY`` per letter of its span, spans of up to ``SPAN`` letters. Signs that are no letter
only widen a span, so ``i.d.i.o.t`` and ``idxiot`` stay close to ``idiot``. The machine works
in the Nyström space of ``LANDMARKS`` strings. Its decision is linear in the subsequences,
so the trained machine folds into one weight per subsequence, and a string is scored
without meeting the landmarks again.

The labels belong to whole texts, the insults to single strings of them: training starts
from the strings that mark toxic texts, near copies of one text counted once, and then, as in multiple-instance learning,
takes the string that the machine finds most toxic from each toxic text. A text scores as
its most toxic string does; a logistic curve fitted on training texts turns that into 0..1.

Training uses only a bounded sample of the labelled rows (``SAMPLE``). Defined cases: null and
empty texts have no strings and score as a harmless one; a null label is no label; several
labels of one id count as the largest; without toxic or clean training texts every score
is the rate of toxic ones; extra columns are ignored, repeated rows are scored alike.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.llm import text as T
from readwindows.llm.frames import free_name
from readwindows.session import stage

#: Labelled rows used in training, in expectation; drawn by a hash of their id.
SAMPLE = 20_000
#: Of these, toxic texts whose strings the driver sees; clean strings it sees.
TOXIC_TEXTS, CLEAN_STRINGS, HARD_STRINGS = 1_500, 10_000, 4_000
LANDMARKS = 96
DECAY, SPAN, WIDTH = 0.7, 7, 24
THRESHOLD = 0.7
CACHE = 150_000

#: Signs often written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LETTERED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
_EDGES = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?[\\]^_`{|}~«»“”‘’…–—"

_SYMBOLS = np.zeros(0x110000, dtype=np.int16)
_SYMBOLS[0xAA:] = 27 + np.arange(0xAA, 0x110000) % 4
for _sign in range(0xC0, 0x250):  # accented Latin letters count as their base letters
    _base = unicodedata.normalize("NFKD", chr(_sign).lower())[0]
    if "a" <= _base <= "z":
        _SYMBOLS[_sign] = ord(_base) - ord("a") + 1
_SYMBOLS[ord("a") : ord("z") + 1] = np.arange(1, 27)
for _sign, _letter in LOOKALIKES.items():
    _SYMBOLS[ord(_sign)] = ord(_letter) - ord("a") + 1
#: Strings whose subsequences are listed at a time: some 15 kB each.
WORDS = 512
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def strings(text: str) -> set[str]:
    """The distinct strings of a text between white space, and runs of single letters as one."""
    low = text.lower()
    found = {w.strip(_EDGES) for w in low.split()}
    found.update(m.group().replace(" ", "") for m in _LETTERED.finditer(low))
    for w in [w for w in found if len(w) > WIDTH]:
        found.discard(w)
        found.update(w[i : i + WIDTH] for i in range(0, len(w) - SPAN, WIDTH - SPAN))
    found.discard("")
    return found


def _codes(words: list[str]) -> np.ndarray:
    points = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    return _SYMBOLS[points].astype(np.int32)


def _terms(codes: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """Weight and subsequence number of every gap pattern; numbers with a zero sign are 0."""
    for a, b in _GAPS:
        s = a + b
        x, y, z = codes[:, : WIDTH - s], codes[:, a : WIDTH - b], codes[:, s:]
        yield DECAY ** (s + 1), np.where((x > 0) & (y > 0) & (z > 0), (x * 32 + y) * 32 + z, 0)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of unit length: row, subsequence, value."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    parts = [(np.full(t.size, w), np.repeat(np.arange(len(words)), t.shape[1]), t.ravel()) for w, t in _terms(_codes(words))]
    value, row, number = (np.concatenate(x) for x in zip(*parts, strict=True))
    used = number > 0
    key, which = np.unique(row[used].astype(np.int64) << 15 | number[used], return_inverse=True)
    value = np.bincount(which, value[used], minlength=len(key))
    row, number = key >> 15, key & 0x7FFF
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(words)))
    return row, number, value / norm[row]


def _dense(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), 1 << 15), np.float32)
    for lo in range(0, len(words), WORDS):
        row, number, value = features(words[lo : lo + WORDS])
        out[lo + row, number] = value
    return out


@dataclass
class Machine:
    """Weights of the subsequences, the offset, and the logistic curve (slope, shift)."""

    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision values; a string without any toxic subsequence gets the offset."""
        out = np.full(len(words), self.offset)
        for lo in range(0, len(words), WORDS):
            part = words[lo : lo + WORDS]
            raw = np.zeros(len(part))
            for w, number in _terms(_codes(part)):
                raw += w * self.weights[number].sum(axis=1)
            up = np.flatnonzero(raw > 0)
            row, number, value = features([part[i] for i in up])
            out[lo + up] += np.bincount(row, value * self.weights[number], minlength=len(up))
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def text_margins(texts: list[str], machine: Machine, cache: dict[str, float]) -> np.ndarray:
    found = [strings(t) for t in texts]
    new = [w for w in set(chain.from_iterable(found)) if w not in cache]
    if len(cache) > CACHE:
        cache.clear()
        new = list(set(chain.from_iterable(found)))
    cache.update(zip(new, machine.margins(new).tolist(), strict=True))
    return np.array([max(map(cache.__getitem__, f), default=machine.offset) for f in found])


def _spread(words: list[str], n: int) -> list[str]:
    """``n`` strings, each as unlike the ones before it as any."""
    if len(words) <= n:
        return words
    words = words[:: max(1, len(words) // (8 * n))]
    x = _dense(words)
    near = np.zeros(len(x))
    chosen = [0]
    while len(chosen) < n:
        near = np.maximum(near, x @ x[chosen[-1]])
        near[chosen[-1]] = 2
        chosen.append(int(near.argmin()))
    return [words[i] for i in chosen]


def _fit(toxic: dict[str, int], clean: dict[str, int]) -> Machine:
    """Squared-hinge machine in Nyström space by Newton steps, folded into subsequence weights.

    Every string counts as often as there are texts of its class that hold it.
    """
    half = LANDMARKS // 2
    landmarks = _spread(list(toxic), half) + _spread(list(clean), half)
    basis = _dense(landmarks)
    values, vectors = np.linalg.eigh(basis @ basis.T + 1e-6 * np.eye(len(basis)))
    root = vectors / np.sqrt(np.maximum(values, 1e-4))
    forms = ((v, n if v == w else n / 4) for w, n in toxic.items() for v in (w, ".".join(w), "-".join(w), w[:2] + "x" + w[2:], w[:-2] + "*" + w[-2:]))
    variants = {v: n for v, n in forms if len(v) <= WIDTH}
    blocks = []
    for words in (list(variants), list(clean)):
        for lo in range(0, len(words), 256):
            blocks.append(_dense(words[lo : lo + 256]) @ basis.T @ root)
    x = np.hstack([np.vstack(blocks), np.ones((len(variants) + len(clean), 1))])
    y = np.repeat([1.0, -1.0], [len(variants), len(clean)])
    c = np.array([*variants.values(), *clean.values()]) / sum(variants.values())
    ridge = 1e-4 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-8
    w = np.zeros(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        xo = x[on] * c[on, None]
        new = np.linalg.solve(xo.T @ x[on] + ridge, xo.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return Machine((root @ w[:-1]) @ basis, float(w[-1]))


def _unlike(texts: list[set[str]]) -> list[set[str]]:
    """The texts without near copies of earlier ones: those that share two of eight minima of their string hashes."""
    salts = np.random.default_rng(4).integers(1, 1 << 32, 8, dtype=np.uint64) | np.uint64(1)
    seen: set[tuple[int, int]] = set()
    out = []
    for found in texts:
        hashes = np.array([crc32(w.encode()) for w in found if len(w) >= 4] or [len(seen)], dtype=np.uint64)
        minima = {(k, int(((hashes * salt) & np.uint64(0xFFFFFFFF)).min())) for k, salt in enumerate(salts)}
        if len(minima & seen) < 2:
            out.append(found)
        seen |= minima
    return out


def _marking(texts: list[set[str]], clean_rate: dict[str, float], n_clean: int) -> list[str]:
    """Strings that occur in far more toxic texts than their rate in clean ones explains."""
    holders = Counter(w for found in texts for w in found if len(w) >= 4)
    out = []
    for w, n in holders.items():
        expected = len(texts) * (clean_rate.get(w, 0.0) + 1 / (n_clean + 2))
        if n >= 4 + expected + 5 * expected**0.5 and clean_rate.get(w, 0.0) < 0.05 * n / len(texts):
            out.append((-n, w))
    return [w for _, w in sorted(out)]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the rows that training may see: those whose hash class isn't held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(marks, "doc_id")


def held_out(name: str):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from a bounded sample of the labelled training rows."""
    ids = labels.where("toxic is not null").agg(F.count("*")).first()[0]
    share = min(1.0, sample / max(ids, 1))
    marks = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = labelled(docs, marks)

    def cut(batches):
        for batch in batches:
            for i, t, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if t:
                    found = sorted(strings(t))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i] * len(found), pa.int64()), "toxic": pa.array([y] * len(found), pa.int32()), "string": pa.array(found, pa.string())})

    held = stage(rows.mapInArrow(cut, "doc_id long, toxic int, string string"), "toxicity")
    per_doc = held.groupBy("doc_id").agg(F.first("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in per_doc.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = counts.get(0, 0), counts.get(1, 0)
    if not n_clean or not n_toxic:
        rate = min(max(n_toxic / max(n_clean + n_toxic, 1), 1e-3), 1 - 1e-3)
        return Machine(np.zeros(1 << 15), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    few = held.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(TOXIC_TEXTS)
    bags = held.join(F.broadcast(few), "doc_id").where("toxic = 1")
    texts: dict[int, set[str]] = {}
    held_by = bags.groupBy("doc_id").agg(F.collect_set("string").alias("strings")).toArrow()
    for i, found in zip(held_by.column("doc_id").to_pylist(), held_by.column("strings"), strict=True):
        texts[i] = set(map(sys.intern, found.as_py()))
    del held_by
    clean = held.where("toxic = 0").groupBy("string").agg(F.count("*").alias("n"))
    both = clean.join(bags.select("string").distinct(), "string", "left_semi").toArrow()
    rates = {sys.intern(w): n / n_clean for w, n in zip(both.column("string").to_pylist(), both.column("n").to_pylist(), strict=True)}
    harmless = {r.string: r.n for r in clean.orderBy(F.xxhash64("string")).limit(CLEAN_STRINGS).collect()}
    harmless |= {w: round(x * n_clean) for w, x in sorted(rates.items(), key=lambda x: (-x[1], x[0]))[:CLEAN_STRINGS]}
    bag_list = _unlike([texts[i] for i in sorted(texts)])
    holders = Counter(chain.from_iterable(bag_list))
    known = set(_marking(bag_list, rates, n_clean)) or set(sorted(set(holders) - set(rates))[:LANDMARKS]) or {"toxic"}
    for _ in range(2):
        machine = _fit({w: max(holders[w], 1) for w in sorted(known)}, {w: n for w, n in sorted(harmless.items()) if w not in known})
        sent = machine

        def judge(batches, sent=sent):
            for batch in batches:
                margins = sent.margins(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_pydict({"string": batch.column(0), "n": batch.column(1), "margin": pa.array(margins, pa.float64())})

        # The clean strings that this machine finds most toxic teach the next one.
        hard = clean.mapInArrow(judge, "string string, n long, margin double").orderBy(F.desc("margin"), "string").limit(HARD_STRINGS)
        harmless |= {r.string: r.n for r in hard.collect()}
        # From each toxic text the most toxic string, if several such texts hold it and no clean one does.
        flat = sorted(w for w, n in holders.items() if n >= 3 and len(w) >= 4 and w not in rates)
        margin = dict(zip(flat, machine.margins(flat).tolist(), strict=True))
        for found in bag_list:
            best = max((w for w in found if w in margin), key=lambda w: (margin[w], w), default=None)
            if best and margin[best] > 0:
                known.add(best)
    machine = _fit({w: max(holders[w], 1) for w in sorted(known)}, {w: n for w, n in sorted(harmless.items()) if w not in known})
    return _calibrated(machine, rows)


def _calibrated(machine: Machine, rows: DataFrame) -> Machine:
    """Logistic curve over the training texts' margins."""
    scored = rows.mapInArrow(_scorer(machine, 1, lambda batch, m: {"toxic": batch.column(2), "margin": pa.array(m, pa.float64())}), "toxic int, margin double")
    table = np.array([(r.toxic, r.margin) for r in scored.collect()], dtype=float).reshape(-1, 2)
    y, m = table[:, 0], table[:, 1]
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([m, np.ones(len(m))])
    w = np.array([1.0, 0.0])
    for turn in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        # Labels are noisy: after some turns, toxic texts without any toxic string no longer pull at the curve.
        use = np.where((y > 0) & (p < 0.2) & (turn >= 10), 0.0, 1.0)
        gradient = x.T @ (use * (p - target)) + np.array([1e-3, 0]) * w
        hessian = (x * (use * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8 and turn > 20:
            break
    return Machine(machine.weights.astype(np.float32), machine.offset, float(max(w[0], 0.0)), float(w[1]))


def _scorer(machine: Machine, at: int, out):
    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            texts = T.binary(batch.column(at))
            for lo, hi in T.pieces(texts):
                part = batch.slice(lo, hi - lo)
                margins = text_margins([t or "" for t in part.column(at).to_pylist()], machine, cache)
                columns = out(part, margins)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs``, and ``score`` in 0..1 under that name or, if taken, with underscores in front."""
    name = "score" if "score" not in [c.lower() for c in docs.columns] else free_name(docs, "score")
    schema = docs.withColumn(name, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches):
        yield from _scorer(sent.value, at, lambda part, m: dict(zip([*part.schema.names, name], [*part.columns, pa.array(sent.value.probability(m), pa.float64())], strict=True)))(batches)

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    scored = score(docs, machine)
    return scored.where(F.col(scored.columns[-1]) < threshold).drop(scored.columns[-1])
