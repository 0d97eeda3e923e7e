import math
import random

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from readwindows.operators import metrics, peaks


def data(n=400, seed=3, hot=0.33):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        score = 0.25 if rng.random() < hot else round(rng.random() * 0.8 + 0.2 * label, 2)
        rows.append((i, label, score))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label int, score double")


def brute(rows):
    positives = sum(l for _, l, _ in rows)
    negatives = len(rows) - positives
    curve, ap, last = [], 0.0, 0.0
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp = sum(l for _, l, s in rows if s >= t)
        n = sum(1 for *_, s in rows if s >= t)
        curve.append((t, tp / n, tp / positives))
        ap += (tp / positives - last) * tp / n
        last = tp / positives
    pos = [s for _, l, s in rows if l]
    neg = [s for _, l, s in rows if not l]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (positives * negatives)
    return curve, ap, auc


@pytest.mark.parametrize("ranges", ["1", "8", "200"])
def test_curves(spark, ranges):
    rows = data()
    curve, ap, auc = brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        found = metrics.pr_curve(table(spark, rows)).collect()
        points = sorted(((r.threshold, r.precision, r.recall) for r in found if r.threshold is not None), reverse=True)
        assert len(points) == len(curve) and [(1.0, 0.0)] == [(r.precision, r.recall) for r in found if r.threshold is None]
        for a, b in zip(points, curve):
            assert a == pytest.approx(b)
        report = metrics.report(table(spark, rows)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert report.average_precision == pytest.approx(ap) and report.roc_auc == pytest.approx(auc)
    tp = sum(1 for _, l, s in rows if l and s > 0.5)
    fp = sum(1 for _, l, s in rows if not l and s > 0.5)
    fn = sum(1 for _, l, s in rows if l and s <= 0.5)
    assert (report.tp, report.fp, report.fn, report.tn) == (tp, fp, fn, len(rows) - tp - fp - fn)
    assert report.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert report.accuracy == pytest.approx((tp + report.tn) / len(rows))
    assert metrics.average_precision(table(spark, rows)).first()[0] == pytest.approx(ap)
    assert metrics.roc_auc(table(spark, rows)).first()[0] == pytest.approx(auc)


def test_one_class(spark):
    df = table(spark, [(0, 0, 0.2), (1, 0, 0.9)])
    report = metrics.report(df).first()
    assert report.roc_auc is None and report.f1 == 0 and report.average_precision == 0
    assert metrics.f1(metrics.with_prediction(df.withColumn("score", F.lit(0.1)))).first()[0] == 0


def test_threshold_is_strict(spark):
    df = metrics.with_prediction(table(spark, [(0, 1, 0.5), (1, 1, 0.500001)]))
    assert {r.id: r.prediction for r in df.collect()} == {0: 0, 1: 1}
    assert metrics.accuracy(df).first()[0] == 0.5


def test_confusion_shows_empty_cells(spark):
    df = metrics.with_prediction(table(spark, [(0, 1, 0.9), (1, 1, 0.1), (2, 1, 0.2)]))
    cells = {(r.truth, r.prediction): r.n for r in metrics.confusion(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 2, (1, 1): 1}


def test_loss_and_batches(spark):
    rows = [(0, 0, 1, 2.0), (0, 0, 0, 800.0), (0, 1, 1, -3.0), (1, 0, 1, 0.0)]
    df = metrics.with_score(spark.createDataFrame(rows, "epoch int, batch int, label int, logit double"))

    def loss(x, y):
        return max(x, 0) - x * y + math.log1p(math.exp(-abs(x)))

    losses = [loss(x, y) for *_, y, x in rows]
    assert metrics.bce(df).first()[0] == pytest.approx(sum(losses) / 4)
    found = {r.epoch: (r.loss, r.accuracy) for r in metrics.by_batch(df).collect()}
    assert found[0] == pytest.approx(((losses[0] + losses[1]) / 2 / 2 + losses[2] / 2, 0.25))
    assert found[1] == pytest.approx((losses[3], 0.0))


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 2.0],), ([-1.0, -3.0],)], "logits array<double>")
    assert [r.prediction for r in metrics.with_argmax(df).collect()] == [0, 1, 0]


def peak_table(spark, widths, contig="chr1"):
    rows = [(contig, 1000 * i, 1000 * i + w) for i, w in enumerate(widths)]
    return spark.createDataFrame(rows, "chrom string, start bigint, `end` bigint")


def test_width_reports(spark):
    widths = [10, 20, 20, 35, 110]
    df = peak_table(spark, widths)
    row = peaks.width_summary(df).first()
    assert tuple(row) == (10, 110, 20.0, 39.0)
    bins = {r.bin: r.peaks for r in peaks.width_histogram(df, 4).collect()}
    assert bins == {0: 3, 1: 1, 2: 0, 3: 1}
    same = peaks.width_histogram(peak_table(spark, [50, 50])).collect()
    assert [(r.bin, r.peaks) for r in same] == [(0, 2)]
    assert peaks.width_histogram(peak_table(spark, [])).count() == 0
    assert peaks.width_density(peak_table(spark, [50, 50])).collect() == []
    h = (sum((w - 39) ** 2 for w in widths) / 4) ** 0.5 * 5**-0.2
    found = {r.point: r for r in peaks.width_density(df, 11).collect()}
    at = found[3].x
    expected = sum(math.exp(-0.5 * ((at - w) / h) ** 2) for w in widths) / (5 * h * math.sqrt(2 * math.pi))
    assert at == 40 and found[3].density == pytest.approx(expected)
    assert found[3].count_scale == pytest.approx(expected * 5 * 100 / 20)
    both = df.unionByName(peak_table(spark, [7], "chr2"))
    series = peaks.width_series(both, "chr2", ["chrom", "start"]).collect()
    assert [tuple(r) for r in series] == [(5, 7)]
    assert peaks.with_width(df).columns == peaks.WIDTH_COLUMNS


def test_cumulative_counts_use_no_single_task(spark):
    plan = plan_of(metrics.cumulative(table(spark, data())))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "EvalPython" not in plan
    sorted_by_score = [line for line in plan.splitlines() if "windowspecdefinition" in line and "score" in line]
    assert sorted_by_score and all("windowspecdefinition(_range" in line for line in sorted_by_score)
