"""Training by epochs of mini-batches, its history, and a search that stops weak settings early.

The model is logistic regression on the shares of a window's k-mers. Rows are dealt to mini-batches once, by a
digest of their sequence, and written by batch; every epoch visits the batches in another seeded order. A
step is one job: each task sums the gradient of its rows, groups of tasks are summed in Spark, and a
bounded number of such sums, as wide as the vocabulary, reaches the driver, which keeps the optimizer's state (Adam).
Several settings are trained side by side: one pass over the rows serves all of them.

Defined cases: rows without a label are left out; a sequence without k-mers has the bias alone; an empty
training table leaves all weights at zero; an empty validation table has null loss, accuracy and area.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.functions import kmers, scores
from readwindows.session import stage

#: Groups of tasks whose sums are added up before they reach the driver.
GROUPS = 32
#: Parts of the unit interval in which validation scores are ranked: scores of one part are ties.
SCORE_PARTS = 1000
# The usual constants of the optimizer.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8

HISTORY = "epoch int, train_loss double, train_accuracy double, val_loss double, val_accuracy double, val_auc double"
TRIALS = "learning_rate double, l2 double, epochs int, pruned boolean, auc double, best boolean"


@dataclass(frozen=True)
class Setting:
    learning_rate: float = 0.05
    l2: float = 0.0


@dataclass(frozen=True)
class Linear:
    """A trained classifier: a weight for the share of each k-mer id, and a bias behind them."""

    k: int
    weights: np.ndarray


def _width(k: int) -> int:
    return kmers.FIRST_KMER_ID + len(kmers.ALPHABET) ** k


def _rows(df: DataFrame, k: int) -> DataFrame:
    return df.where("labels is not null").select(F.col("labels").cast("double").alias("y"), kmers.encode(F.col("query_subseq"), k).alias("ids"), "query_subseq")


class _Batch:
    """Labels and shares of the rows of an Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, width: int) -> None:
        self.y, self.width = batch.column("y").to_numpy(), width
        ids = batch.column("ids")
        sizes = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        self.ids = ids.flatten().to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.share = 1.0 / np.maximum(sizes, 1)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        found = np.bincount(self.row, weights[self.ids], minlength=len(self.y)) if len(self.ids) else np.zeros(len(self.y))
        return found * self.share + weights[-1]

    def gradient(self, error: np.ndarray) -> np.ndarray:
        each = np.bincount(self.ids, (error * self.share)[self.row], minlength=self.width) if len(self.ids) else np.zeros(self.width)
        return np.append(each, error.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def _summed(rows: DataFrame, size: int, sums) -> np.ndarray:
    """The total of ``sums(batch)``, an array of ``size`` numbers, over all rows."""
    out = "part long, total binary"

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += sums(batch)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % GROUPS]), "total": pa.array([total.tobytes()], pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_buffer()) for v in table.column("total")], axis=0)
        return pa.table({"part": table.column("part")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, out).groupBy("part").applyInArrow(join, out)
    return np.sum([np.zeros(size), *(np.frombuffer(r.total) for r in parts.collect())], axis=0)


def _losses(y: np.ndarray, logits: np.ndarray) -> tuple[float, float]:
    """Sum of the cross entropy, and how many rows are on the right side."""
    return float((np.logaddexp(0.0, logits) - y * logits).sum()), float((scores_above(logits) == y).sum())


def scores_above(logits: np.ndarray) -> np.ndarray:
    return (_sigmoid(logits) > 0.5).astype(float)


@dataclass
class _Trial:
    """A setting, its weights and the state of its optimizer."""

    setting: Setting
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    history: list[tuple] = field(default_factory=list)
    pruned: bool = False
    done: bool = False
    stale: int = 0

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        gradient = gradient + self.setting.l2 * np.append(self.weights[:-1], 0.0)
        self.first = BETA1 * self.first + (1 - BETA1) * gradient
        self.second = BETA2 * self.second + (1 - BETA2) * gradient**2
        mean, power = self.first / (1 - BETA1**self.steps), self.second / (1 - BETA2**self.steps)
        self.weights = self.weights - self.setting.learning_rate * mean / (np.sqrt(power) + EPSILON)

    def best(self) -> float:
        return max((h[-1] for h in self.history if h[-1] is not None), default=float("-inf"))


def batch_order(batches: int, seed: int, epoch: int) -> list[int]:
    """The order in which an epoch, counted from 1, visits the batches."""
    return sorted(range(batches), key=lambda b: hashlib.md5(f"{seed}-{epoch}-{b}".encode()).hexdigest())


def _area(positive: np.ndarray, negative: np.ndarray) -> float | None:
    """Area under the ROC curve from the counts by score; equal scores count half."""
    below = np.cumsum(negative) - negative
    pairs = positive.sum() * negative.sum()
    return float((positive * (below + negative / 2)).sum() / pairs) if pairs else None


class _Training:
    def __init__(self, train: DataFrame, val: DataFrame, k: int, batches: int, seed: int, settings: Sequence[Setting]) -> None:
        self.width, self.batches, self.seed = _width(k), batches, seed
        key = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "query_subseq")), 1, 8), 16, 10).cast("bigint")
        rows = _rows(train, k).withColumn("batch", F.pmod(key, F.lit(batches)))
        self.train = stage(rows.drop("query_subseq").sort("batch"), "batches")
        self.val = stage(_rows(val, k).drop("query_subseq"), "validation")
        zero = np.zeros(self.width + 1)
        self.trials = [_Trial(s, zero, zero, zero) for s in settings]

    def live(self) -> list[_Trial]:
        return [t for t in self.trials if not (t.pruned or t.done)]

    def epoch(self, number: int) -> None:
        live, width = self.live(), self.width
        totals = np.zeros((len(live), 3))
        for batch_number in batch_order(self.batches, self.seed, number):
            all_weights = [t.weights for t in live]

            def gradients(batch, all_weights=all_weights):
                rows, out = _Batch(batch, width), []
                for weights in all_weights:
                    logits = rows.logits(weights)
                    out.append(np.concatenate([[len(rows.y), *_losses(rows.y, logits)], rows.gradient(_sigmoid(logits) - rows.y)]))
                return np.concatenate(out)

            found = _summed(self.train.where(F.col("batch") == batch_number), len(live) * (width + 4), gradients).reshape(len(live), -1)
            totals += found[:, :3]
            for trial, row in zip(live, found, strict=True):
                if row[0]:
                    trial.step(row[3:] / row[0])
        self._evaluate(number, live, totals)

    def _evaluate(self, number: int, live: list[_Trial], train: np.ndarray) -> None:
        all_weights, width = [t.weights for t in live], self.width

        def measures(batch):
            rows, out = _Batch(batch, width), []
            for weights in all_weights:
                logits = rows.logits(weights)
                place = np.minimum((_sigmoid(logits) * SCORE_PARTS).astype(np.int64), SCORE_PARTS - 1)
                counts = [np.bincount(place, rows.y == label, minlength=SCORE_PARTS) for label in (1, 0)]
                out.append(np.concatenate([[len(rows.y), *_losses(rows.y, logits)], *counts]))
            return np.concatenate(out)

        found = _summed(self.val, len(live) * (3 + 2 * SCORE_PARTS), measures).reshape(len(live), -1)
        for trial, before, after in zip(live, train, found, strict=True):
            mean = [float(m[i] / m[0]) if m[0] else None for m in (before, after) for i in (1, 2)]
            trial.history.append((number, *mean, _area(after[3 : 3 + SCORE_PARTS], after[3 + SCORE_PARTS :])))


def train(
    train: DataFrame, val: DataFrame, k: int = 6, epochs: int = 3, batches: int = 8, learning_rate: float = 0.05, l2: float = 0.0, seed: int = 42
) -> tuple[Linear, DataFrame]:
    """The classifier after the last epoch, and a row of ``HISTORY`` for every epoch.

    Training loss and accuracy are those of each batch before its step, as it is seen during
    the epoch; validation follows the epoch's last step.
    """
    run = _Training(train, val, k, batches, seed, [Setting(learning_rate, l2)])
    for number in range(1, epochs + 1):
        run.epoch(number)
    trial = run.trials[0]
    return Linear(k, trial.weights), train.sparkSession.createDataFrame(trial.history, HISTORY)


def search(
    train: DataFrame, val: DataFrame, settings: Sequence[Setting], k: int = 6, epochs: int = 3, batches: int = 8, seed: int = 42, warm_up: int = 1, patience: int | None = None
) -> DataFrame:
    """A row of ``TRIALS`` for each setting; ``best`` marks the largest area under the ROC curve (of several, the first setting).

    All settings go through an epoch together and report their area. From epoch ``warm_up`` on, a setting whose
    best report is below the median report of that epoch is stopped; so is one that hasn't improved
    for ``patience`` epochs (not marked as pruned). ``setting_of`` turns the best row into a setting to train with.
    """
    run = _Training(train, val, k, batches, seed, settings)
    for number in range(1, epochs + 1):
        if not run.live():
            break
        run.epoch(number)
        live = run.live()
        reports = [t.history[-1][-1] for t in live if t.history[-1][-1] is not None]
        middle = float(np.median(reports)) if reports else float("-inf")
        for trial in live:
            *earlier, now = [h[-1] if h[-1] is not None else float("-inf") for h in trial.history]
            trial.stale = 0 if not earlier or now > max(earlier) else trial.stale + 1
            if number < epochs and number >= warm_up and trial.best() < middle:
                trial.pruned = True
            trial.done = patience is not None and trial.stale >= patience
    best = max(run.trials, key=_Trial.best, default=None)
    rows = [(t.setting.learning_rate, t.setting.l2, len(t.history), t.pruned, None if t.best() == float("-inf") else t.best(), t is best) for t in run.trials]
    return train.sparkSession.createDataFrame(rows, TRIALS)


def setting_of(trials: DataFrame) -> Setting:
    row = trials.where("best").first()
    return Setting(row.learning_rate, row.l2)


def score(model: Linear, df: DataFrame) -> DataFrame:
    """Add ``label``, ``logit``, ``score`` and ``prediction``.

    Weights are a literal array: a window's logit is the mean of the weights of its k-mers, and the bias.
    """
    weights = F.lit([float(w) for w in model.weights[:-1]])
    ids = kmers.encode(F.col("query_subseq"), model.k)
    total = F.aggregate(ids, F.lit(0.0), lambda s, i: s + F.get(weights, i))
    logit = total / F.greatest(F.size(ids), F.lit(1)) + F.lit(float(model.weights[-1]))
    kept = [c for c in df.columns if c not in ("label", "logit", "score", "prediction")]
    scored = df.withColumn("label", F.col("labels").cast("int")).withColumn("logit", logit)
    scored = scored.withColumn("score", scores.sigmoid(F.col("logit")))
    return scored.select(*kept, "label", "logit", "score", scores.predicted(F.col("score")).alias("prediction"))
