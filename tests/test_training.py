"""Epochs, their history and the search, against a direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readwindows.operators import training
from readwindows.operators.training import Setting

SCHEMA = "query_subseq string, labels int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)

    def rows(n):
        return [("".join(rng.choices("ACGT" if i % 2 else "AACGTT", k=80)), i % 2) for i in range(n)]

    return [spark.createDataFrame(rows(n), SCHEMA).cache() for n in (240, 90)]


def test_history_falls(spark, tables):
    model, history = training.train(*tables, k=2, epochs=6, batches=3)
    found = history.orderBy("epoch").collect()
    assert [r.epoch for r in found] == list(range(1, 7))
    assert found[-1].train_loss < found[0].train_loss and found[-1].val_loss < found[0].val_loss
    assert found[-1].val_auc > 0.8 and found[-1].val_accuracy > 0.6
    again, _ = training.train(tables[0].repartition(7), tables[1], k=2, epochs=6, batches=3)
    assert np.allclose(model.weights, again.weights, atol=1e-9)
    scored = training.score(model, tables[1])
    assert scored.columns == ["query_subseq", "labels", "label", "logit", "score", "prediction"]
    measured = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")), F.avg(-F.ln(F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))))).first()
    assert measured[0] == pytest.approx(found[-1].val_accuracy) and measured[1] == pytest.approx(found[-1].val_loss)


def test_one_batch_is_gradient_descent(spark):
    rows = [("AAC", 1), ("CCA", 0), ("AAA", 1), ("", 0), (None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    model, history = training.train(df, df, k=1, epochs=2, batches=1, learning_rate=0.1, l2=0.5)
    x = np.zeros((5, 7))
    for i, (s, _) in enumerate(rows):
        for letter in s or "":
            x[i, 2 + "ACGT".index(letter)] += 1 / len(s)
    x[:, -1] = 1
    y = np.array([label for _, label in rows])
    w, m, v = np.zeros(7), np.zeros(7), np.zeros(7)
    for t in (1, 2):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / 5 + 0.5 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(model.weights, w, atol=1e-6)
    assert history.count() == 2


def test_search_stops_weak_settings(spark, tables):
    settings = [Setting(0.05), Setting(1e-5), Setting(0.0001, 5.0), Setting(0.2), Setting(0.1)]
    whole = training.search(*tables, settings, k=2, epochs=4, batches=2, warm_up=99)
    found = training.search(*tables, settings, k=2, epochs=4, batches=2)
    full, some = whole.collect(), found.collect()
    assert [r.epochs for r in full] == [4] * 5 and sum(r.epochs for r in some) < 20
    assert any(r.pruned for r in some) and all(r.epochs == 4 for r in some if not r.pruned)
    assert training.setting_of(found) == training.setting_of(whole)
    assert sum(r.best for r in some) == 1 and max(r.auc for r in some) == next(r.auc for r in some if r.best)
    patient = training.search(*tables, [Setting(0.0)], k=2, epochs=5, batches=1, patience=1).first()
    assert patient.epochs == 2 and not patient.pruned


def test_empty_tables(spark, tables):
    none = spark.createDataFrame([], SCHEMA)
    model, history = training.train(none, none, k=2, epochs=1)
    row = history.first()
    assert not model.weights.any() and row.train_loss is None and row.val_auc is None
    assert training.search(none, none, [Setting()], k=2, epochs=1).first().auc is None
    unlabelled = tables[0].withColumn("labels", F.lit(None).cast("int"))
    assert training.train(unlabelled, tables[1], k=2, epochs=1)[1].first().train_loss is None


def test_area():
    scores = [(0, 1), (0, 0), (1, 0), (2, 1), (2, 1), (2, 0), (3, 1)]
    positive, negative = np.zeros(4), np.zeros(4)
    for place, label in scores:
        (positive if label else negative)[place] += 1
    pairs = [(p, n) for p, a in scores if a for n, b in scores if not b]
    assert training._area(positive, negative) == pytest.approx(sum((p > n) + (p == n) / 2 for p, n in pairs) / len(pairs))
    assert training._area(np.zeros(4), negative) is None
