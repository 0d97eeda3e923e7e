"""Whitening of vectors by a QR tree and a bidiagonal quotient-difference solver.

Entries become whole numbers, ``floor(SCALE * entry) + SHIFT``, so sums are exact whatever the order of
tasks. Every task reduces its centred rows block by block to one triangle; triangles are
joined in groups, round by round, until one is left, which is as wide as a vector. ``qd`` finds its
singular values and right vectors on the driver: they are the covariance's eigenvalues (times the number of rows) and the components.

Defined cases: rows whose vector is null or holds a null, infinite or undefined entry are dropped; so are rows whose length isn't the
commonest one (of several, the longest), empty vectors included. Whole numbers beyond 62 bits stop there. Rows of equal or null id are rows of their own.
A component without variance (its eigenvalue is rounding of the largest) can't be whitened and is left out: constant
tables and single rows give no rows, as does an empty table. ``deviation`` is a decimal of 38 digits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.llm import qd
from readwindows.session import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows that a task reduces at once, and bytes of triangles that one joins.
ROWS, JOINED = 4096, 64 << 20
_LARGEST = float(1 << 62)

_SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def _whole(batches: Iterator[pa.RecordBatch], width: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers of the usable rows, one array per batch and length; only of ``width`` if that is given."""
    for batch in batches:
        column = batch.column(1)
        there = column.is_valid()
        ids, column = batch.column(0).filter(there), column.filter(there)
        at = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy().astype(np.int64))))
        entries = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        wrong = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
        lengths = np.diff(at)
        usable = (wrong[at[1:]] == wrong[at[:-1]]) & (lengths > 0)
        for length in np.unique(lengths[usable]) if width is None else [width]:
            rows = np.flatnonzero(usable & (lengths == length))
            if len(rows):
                values = entries[at[rows][:, None] + np.arange(length)]
                whole = np.floor(np.clip(values * SCALE, -_LARGEST, _LARGEST - SHIFT)).astype(np.int64) + SHIFT
                yield ids.take(pa.array(rows)), whole


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows are usable, and the sum of each dimension, exact."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for _, whole in _whole(batches):
            n, high, low = held.setdefault(whole.shape[1], [0, 0, 0])
            held[whole.shape[1]] = [n + len(whole), high + (whole >> 32).sum(axis=0), low + (whole & 0xFFFFFFFF).sum(axis=0)]
        for width, (n, high, low) in held.items():
            yield pa.RecordBatch.from_pydict({"width": pa.array([width] * width, pa.int32()), "dim": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "high": pa.array(high), "low": pa.array(low)})

    parts = rows.mapInArrow(run, "width int, dim int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    total = stage(parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), (wide("high") * F.lit(1 << 32) + wide("low")).alias("s")), "sums")
    best = total.where("dim = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return 0, []
    found = total.where(F.col("width") == best.width).orderBy("dim").collect()
    return best.n, [int(r.s) for r in found]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle of a QR factorisation; missing rows are zero."""
    made = np.linalg.qr(rows, mode="r")
    return np.vstack([made, np.zeros((rows.shape[1] - len(made), rows.shape[1]))])


class Centre:
    """Exact means: a whole part and a rest that is less than one."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.width = n, len(sums)
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return (whole - self.base).astype(float) - self.rest / self.n

    def deviation(self, whole: np.ndarray) -> pa.Array:
        """Per row the sum of (n * x - S)**2."""
        off = whole - self.base
        if self.width * (self.n * (float(np.abs(off).max(initial=0)) + 1)) ** 2 < 2**62:
            square = ((off * self.n - self.rest) ** 2).sum(axis=1)
            return pa.array(square).cast(pa.decimal128(38, 0))
        square = ((off.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([v if v < 10**38 else None for v in square], pa.decimal128(38, 0))


def _reduced(rows: DataFrame, centre: Centre) -> np.ndarray:
    """The triangle of all centred rows."""
    width = centre.width
    out = "k long, r binary"

    def one(k: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def run(batches):
        r = None
        for _, whole in _whole(batches, width):
            for lo in range(0, len(whole), ROWS):
                block = centre.centred(whole[lo : lo + ROWS])
                r = _triangle(block if r is None else np.vstack([r, block]))
        if r is not None:
            yield one(TaskContext.get().partitionId(), r)

    fan = max(2, min(64, JOINED // (8 * width * width)))

    def join(table: pa.Table) -> pa.Table:
        r = None
        for value in table.column("r"):
            block = np.frombuffer(value.as_buffer(), float).reshape(width, width)
            r = block if r is None else _triangle(np.vstack([r, block]))
        return pa.Table.from_batches([one(table.column("k")[0].as_py() // fan, r)])

    made = stage(rows.mapInArrow(run, out), "triangles")
    while made.count() > 1:
        made = stage(made.groupBy(F.floor(F.col("k") / fan)).applyInArrow(join, out), "triangles")
    return np.frombuffer(made.first().r, float).reshape(width, width)


class Model:
    """Components as columns, scaled to unit variance, and the share of variance of each."""

    def __init__(self, centre: Centre, triangle: np.ndarray, components: int) -> None:
        squares, vectors = qd.right_vectors(triangle)
        top = float(squares[0]) if len(squares) else 0.0
        kept = min(components, int((squares > top * (np.finfo(float).eps * len(squares)) ** 2).sum()))
        self.centre = centre
        self.eigenvalues = squares[:kept] / centre.n
        self.components = vectors[:, :kept]
        self.explained = squares[:kept] / squares.sum() if kept else squares[:0]

    def whitened(self, whole: np.ndarray) -> np.ndarray:
        return self.centre.centred(whole) @ self.components / np.sqrt(self.eigenvalues)


def _rows(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>"))


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Model | None:
    """Trained on all usable rows; None if there are none."""
    rows = _rows(vectors, column)
    n, sums = _sums(rows)
    if not n:
        return None
    centre = Centre(n, sums)
    return Model(centre, _reduced(rows, centre), components)


def identity_error(vectors: DataFrame, model: Model, column: str = "embedding") -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    width, m = model.centre.width, len(model.eigenvalues)

    def run(batches):
        total = np.zeros((m, m))
        for _, whole in _whole(batches, width):
            for lo in range(0, len(whole), ROWS):
                white = model.whitened(whole[lo : lo + ROWS])
                total += white.T @ white
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(m * m), pa.int64()), "v": pa.array(total.ravel())})

    cells = _rows(vectors, column).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    on = (F.col("cell") % (m + 1) == 0).cast("double")
    return cells.agg(F.max(F.abs(F.col("v") / model.centre.n - on))).first()[0]


def whiten(vectors: DataFrame, model: Model | None, column: str = "embedding") -> DataFrame:
    """A row per usable row of ``vectors`` and component."""
    rows = _rows(vectors, column)
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    width, m, n = model.centre.width, len(model.eigenvalues), model.centre.n

    def run(batches):
        for ids, whole in _whole(batches, width):
            size = len(whole)
            each = pa.array(np.repeat(np.arange(size), m))
            out = {"vec_id": ids.take(each), "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)), "n": pa.array(np.full(size * m, n)), "deviation": model.centre.deviation(whole).take(each)}
            out |= {"whitened": pa.array(model.whitened(whole).ravel()), "explained": pa.array(np.tile(model.explained, size))}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, _SCHEMA)


def fit_and_whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """``whiten`` for a model of the same rows, with the identity error of all of them."""
    model = fit(vectors, components, column)
    error = identity_error(vectors, model, column) if model is not None and len(model.eigenvalues) else None
    return whiten(vectors, model, column).withColumn("identity_error", F.lit(error).cast("double"))
