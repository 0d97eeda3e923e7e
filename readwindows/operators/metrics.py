"""Classification metrics on a scored table with ``label`` and ``score`` or ``prediction``.

Curves are built from one row per distinct score. Cumulative counts need the scores in
order; the table is cut into score ranges, summed inside each range by its own task, and
completed by the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readwindows.functions import scores
from readwindows.session import stage

MAX_RANGES = 10_000


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", scores.sigmoid(F.col("logit")))


def with_prediction(df: DataFrame, threshold: float = scores.THRESHOLD) -> DataFrame:
    return df.withColumn("prediction", scores.predicted(F.col("score"), threshold))


def with_argmax(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("prediction", scores.argmax(F.col(logits)))


def confusion(df: DataFrame, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """``(truth, prediction, n)`` for every pair of ``labels``, zeros included.

    Truth in rows, prediction in columns.
    """
    cells = [(t, p) for t in labels for p in labels]
    counted = df.agg(
        *[F.count_if((F.col("label") == t) & (F.col("prediction") == p)).alias(f"n{t}_{p}") for t, p in cells]
    )
    rows = [
        F.struct(F.lit(t).alias("truth"), F.lit(p).alias("prediction"), F.col(f"n{t}_{p}").alias("n"))
        for t, p in cells
    ]
    return counted.select(F.inline(F.array(*rows)))


def accuracy(df: DataFrame, threshold: float = scores.THRESHOLD) -> DataFrame:
    hit = scores.predicted(F.col("score"), threshold) == F.col("label")
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 when there is neither a positive nor a positive prediction."""
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def f1(df: DataFrame) -> DataFrame:
    """F1 of class 1 from ``label`` and ``prediction``."""
    truth, guess = F.col("label") == 1, F.col("prediction") == 1
    return df.agg(
        _f1(F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess)).alias("f1")
    )


def _score_ranges(df: DataFrame) -> list[float]:
    """Cut points that divide the distinct scores about evenly (an action with a bounded result)."""
    parts = min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [i / parts for i in range(1, parts)] or [0.5]
    found = df.agg(F.percentile_approx("score", at, max(1_000, 4 * parts))).first()[0] or []
    return [float("-inf"), *sorted(set(found)), float("inf")]


def cumulative(df: DataFrame) -> DataFrame:
    """Per distinct score: ``pos`` and ``neg`` with it, and how many have it or a higher one.

    Columns ``score, pos, neg, tp, fp, positives, negatives``. ``df`` is read once, into a staged table of
    its distinct scores; all else comes from that table.
    """
    counts = df.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    counts = stage(counts, "scores")
    ranges = Bucketizer(
        splits=_score_ranges(counts), inputCol="score", outputCol="_range", handleInvalid="error"
    ).transform(counts)
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = (  # one row per range
        ranges.groupBy("_range")
        .agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
        .select(
            "_range",
            F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp"),
            F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_fp"),
            F.sum("_pos").over(everything).alias("positives"),
            F.sum("_neg").over(everything).alias("negatives"),
        )
    )
    inside = Window.partitionBy("_range").orderBy(F.desc("score"))
    return (
        ranges
        .withColumn("tp", F.sum("pos").over(inside))
        .withColumn("fp", F.sum("neg").over(inside))
        .join(F.broadcast(totals), "_range")
        .select(
            "score",
            "pos",
            "neg",
            (F.col("tp") + F.col("_tp")).alias("tp"),
            (F.col("fp") + F.col("_fp")).alias("fp"),
            "positives",
            "negatives",
        )
    )


def _precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def pr_curve(df: DataFrame) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, and the end point (1, 0)."""
    points = cumulative(df).select(
        F.col("score").alias("threshold"),
        _precision().alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(1.0)).alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def _average_precision() -> Column:
    gained = F.try_divide(F.col("pos"), F.col("positives"))
    return F.coalesce(F.sum(gained * _precision()), F.lit(0.0))


def _roc_auc() -> Column:
    """Chance that a positive outscores a negative, ties counting half; null with one class."""
    below = F.col("negatives") - F.col("fp")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return F.try_divide(wins, F.first("positives") * F.first("negatives").cast("double"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of precision times the gain in recall; not the area by trapezes."""
    return cumulative(df).agg(_average_precision().alias("average_precision"))


def roc_auc(df: DataFrame) -> DataFrame:
    return cumulative(df).agg(_roc_auc().alias("roc_auc"))


def bce(df: DataFrame) -> DataFrame:
    """Mean binary cross entropy of ``logit`` against ``label``."""
    return df.agg(F.avg(scores.bce_with_logits(F.col("logit"), F.col("label"))).alias("loss"))


def by_batch(df: DataFrame, threshold: float = scores.THRESHOLD) -> DataFrame:
    """Loss and accuracy per epoch as the mean over batches, a short batch counting in full."""
    hit = (scores.predicted(F.col("score"), threshold) == F.col("label")).cast("double")
    per_batch = df.groupBy("epoch", "batch").agg(
        F.avg(scores.bce_with_logits(F.col("logit"), F.col("label"))).alias("loss"), F.avg(hit).alias("accuracy")
    )
    return per_batch.groupBy("epoch").agg(F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"))


def report(df: DataFrame, threshold: float = scores.THRESHOLD) -> DataFrame:
    """Confusion cells, accuracy, F1, average precision and ROC AUC: one row.

    All of them follow from the counts per distinct score, for which ``df`` is read once.
    """
    high = F.col("score") > threshold
    return (
        cumulative(df)
        .agg(
            F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(high, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(high, 0).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(high, 0).otherwise(F.col("neg"))).alias("tn"),
            _average_precision().alias("average_precision"),
            _roc_auc().alias("roc_auc"),
        )
        .select(
            "tp",
            "fp",
            "fn",
            "tn",
            ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
            _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
            "average_precision",
            "roc_auc",
        )
    )
