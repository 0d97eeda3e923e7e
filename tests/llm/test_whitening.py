"""The qd solver against NumPy's, and whitening against a direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from readwindows.llm import qd, whitening

RNG = np.random.default_rng(5)


def matrices():
    yield RNG.standard_normal((50, 8))
    yield RNG.standard_normal((400, 40)) * np.logspace(0, -9, 40)
    yield RNG.standard_normal((5, 12))
    yield np.ones((6, 4))
    yield np.eye(7)
    yield np.zeros((4, 3))
    yield RNG.standard_normal((9, 1))
    yield np.diag([5.0] * 6 + [3.0] * 6 + [1.0] * 8) @ np.linalg.qr(RNG.standard_normal((20, 20)))[0]
    grown = np.abs(np.arange(21) - 10.0)
    yield np.linalg.cholesky(np.diag(grown + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T


@pytest.mark.parametrize("matrix", list(matrices()))
def test_right_vectors(matrix):
    triangle = whitening._triangle(matrix)
    values, vectors = qd.right_vectors(triangle)
    top = max(values[0], 1e-300)
    assert np.allclose(values, np.linalg.svd(triangle, compute_uv=False) ** 2, rtol=1e-11, atol=1e-14 * top)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(triangle.T @ (triangle @ vectors) - vectors * values).max() <= 1e-13 * top


def direct(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1], turned[:, ::-1]
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return centred @ turned / np.sqrt(values), values / values.sum(), exact


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit("y"))


@pytest.mark.parametrize("width", [3, 40])
def test_whitened_rows(spark, width):
    good = (RNG.standard_normal((300, width)) @ RNG.standard_normal((width, width))).tolist()
    wrong = [None, [], [None] * width, [math.nan] + [1.0] * (width - 1), [math.inf] + [0.0] * (width - 1), [1.0] * (width + 1)]
    rows = [(k, v) for k, v in enumerate(good)] + [(1000 + k, v) for k, v in enumerate(wrong)]
    found = whitening.fit_and_whiten(table(spark, rows).repartition(7)).collect()
    white, explained, exact = direct(good)
    m = min(width, 32)
    assert {(r.vec_id, r.component) for r in found} == {(k, c + 1) for k in range(300) for c in range(m)} and len(found) == 300 * m
    assert all(r.n == 300 and int(r.deviation) == exact[r.vec_id] for r in found)
    assert all(abs(abs(r.whitened) - abs(white[r.vec_id, r.component - 1])) < 1e-8 for r in found)
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 for r in found)
    got = np.zeros((300, m))
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(got.T @ got / 300 - np.eye(m)).max() < 1e-9
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_triangles_are_joined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "JOINED", 2 * 8 * 4 * 4)
    good = RNG.standard_normal((200, 4)).tolist()
    model = whitening.fit(table(spark, list(enumerate(good))).repartition(11))
    assert np.allclose(model.explained, direct(good)[1])


def test_rows_without_variance(spark):
    same = [(None, [1.0, 2.0])] * 4
    assert whitening.fit_and_whiten(table(spark, same)).collect() == []
    assert whitening.fit_and_whiten(table(spark, [])).collect() == []
    line = [(1, [0.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 2.0])]
    found = whitening.fit_and_whiten(table(spark, line)).collect()
    assert len(found) == 3 and {r.component for r in found} == {1} and {r.explained for r in found} == {1.0}


def test_large_entries_are_exact(spark):
    rows = [(k, [k * 1e13, -k * 3e12]) for k in range(50)]
    found = {r.vec_id: int(r.deviation) for r in whitening.fit_and_whiten(table(spark, rows)).where("component = 1").collect()}
    x = [[math.floor(64 * v) + 1_000_000 for v in row] for _, row in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    assert found == {k: sum((50 * a - s) ** 2 for a, s in zip(x[k], total, strict=True)) for k in range(50)}
