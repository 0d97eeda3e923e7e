import random

import pytest
from pyspark.sql import functions as F

from readwindows import Params
from readwindows.operators import metrics, model
from readwindows.plans.evaluate import train_and_evaluate
from readwindows.plans.peak_report import peak_report


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)

    def rows(n):
        made = []
        for i in range(n):
            label = i % 2
            letters = "ACGT" if label else "AACGTT"
            made.append(("".join(rng.choices(letters, k=120)), label))
        return spark.createDataFrame(made, "query_subseq string, labels int").cache()

    return rows(300), rows(120)


def test_train_score_and_history(spark, tables):
    train, val = tables
    fitted = model.fit(train, k=3)
    scored = model.score(fitted, val)
    assert scored.columns == ["query_subseq", "labels", *model.SCORED_COLUMNS]
    report = metrics.report(scored).first()
    assert report.roc_auc > 0.8
    row = scored.first()
    assert row.prediction == int(row.score > 0.5)
    losses = [r.loss for r in model.history(fitted, spark).orderBy("iteration").collect()]
    assert len(losses) > 2 and losses[-1] < losses[0]


def test_tuning(spark, tables):
    settings = model.grid(regParam=[0.0, 0.1], elasticNetParam=[0.0, 1.0])
    found = model.tune(*tables, settings, k=2).collect()
    assert len(found) == 4 and [r.auc for r in found] == sorted((r.auc for r in found), reverse=True)
    assert found[0].params.startswith("elasticNetParam=")


def test_counts_use_the_fixed_vocabulary():
    assert model._vocabulary(2)[:5] == ["AA", "AC", "AG", "AT", "CA"] and len(model._vocabulary(3)) == 64


@pytest.mark.parametrize("k", [1, 2, 5])
def test_features_are_the_counts_of_the_fixed_vocabulary(spark, k):
    texts = ["ACGTACGTTTGACA", "", None, "A", "ACNGTTA", "acgtACG", "ACGéTTACC", "T" * 300]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "query_subseq string, labels int").coalesce(1)
    slow = model.counter(k).transform(model.with_kmers(df, k)).select("query_subseq", "label", "features")
    fast = model.with_features(df, k).select("query_subseq", "label", "features")
    assert fast.collect() == slow.collect() and fast.schema.names == slow.schema.names


def test_training_reads_written_features(spark, tables, monkeypatch):
    plans, write = [], model.stage
    monkeypatch.setattr(model, "stage", lambda df, name: (plans.append(df.columns), write(df, name))[1])
    model.fit(tables[0], k=2)
    assert plans == [["label", "features"]]


def test_train_and_evaluate(tables):
    train, val = tables
    splits = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    made = train_and_evaluate(splits, Params(kmer_size=2))
    cells = {(r.truth, r.prediction): r.n for r in made.confusion.collect()}
    report = made.report.first()
    assert (cells[1, 1], cells[0, 1], cells[1, 0], cells[0, 0]) == (report.tp, report.fp, report.fn, report.tn)
    assert sum(cells.values()) == val.count() and made.loss.first().loss > 0
    leaky = splits.unionByName(train.limit(1).withColumn("split", F.lit("test")))
    with pytest.raises(ValueError, match="leak"):
        train_and_evaluate(leaky, Params(kmer_size=2))


def test_peak_report(spark):
    peaks = spark.createDataFrame(
        [("chr1", 0, 10), ("chr1", 20, 50), ("chr2", 0, 100)], "chrom string, start bigint, `end` bigint"
    )
    made = peak_report(peaks, "chr1")
    assert made.summary.first().max_width == 100 and made.widths.count() == 2
    assert sum(r.peaks for r in made.histogram.collect()) == 2
    assert sorted(map(tuple, made.series.collect())) == [(0, 10), (1, 30)]
    assert made.density.count() == 200
