"""A baseline window classifier: k-mer counts and logistic regression."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from readwindows.functions import kmers, scores
from readwindows.session import stage

SCORED_COLUMNS = ["label", "logit", "score", "prediction"]


def _vocabulary(k: int) -> list[str]:
    words = [""]
    for _ in range(k):
        words = [w + letter for w in words for letter in kmers.ALPHABET]
    return words


def with_kmers(df: DataFrame, k: int, sequence: str = "query_subseq", label: str = "labels") -> DataFrame:
    """k-mer lists and a ``label``, next to the columns of ``df``: what ``counter`` reads."""
    return df.withColumn("_kmers", kmers.split(F.col(sequence), k)).withColumn(
        "label", F.col(label).cast("int")
    )


def counter(k: int) -> CountVectorizerModel:
    """Counts over the fixed vocabulary: no pass over the data is needed to know it."""
    return CountVectorizerModel.from_vocabulary(_vocabulary(k), inputCol="_kmers", outputCol="features")


def _sparse(column: pa.Array, k: int) -> pa.Array:
    """Of every sequence the counts of its known k-mers, as Spark ML stores a sparse vector."""
    width, indices, values, sizes = len(kmers.ALPHABET) ** k, [], [], []
    for ids, counts in kmers.id_blocks(column, k):
        known = ids >= kmers.FIRST_KMER_ID
        cells = (np.repeat(np.arange(len(counts)), counts)[known] * width + ids[known]) - kmers.FIRST_KMER_ID
        if len(counts) * width <= 4 * len(cells):
            n = np.bincount(cells, minlength=len(counts) * width)
            found = np.flatnonzero(n)
            n = n[found]
        else:
            found, n = np.unique(cells, return_counts=True)
        indices.append((found % width).astype(np.int32))
        values.append(n.astype(float))
        sizes.append(np.bincount(found // width, minlength=len(counts)))
    at = pa.array(np.cumsum(np.concatenate([[0], *sizes])), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, kind), *parts]))) for kind, parts in ((np.int32, indices), (float, values))]
    heads = [pa.array(np.zeros(len(column), np.int8)), pa.array(np.full(len(column), width, np.int32))]
    return pa.StructArray.from_arrays([*heads, *lists], ["type", "size", "indices", "values"])


def with_features(df: DataFrame, k: int, sequence: str = "query_subseq", label: str = "labels") -> DataFrame:
    """``features``, the vectors that ``counter`` makes of ``with_kmers``, and ``label``.

    The k-mers of a whole Arrow batch are counted as numbers; no string is made of any.
    """
    counted = F.arrow_udf(lambda column: _sparse(column, k), VectorUDT())(F.col(sequence))
    return df.withColumn("features", counted).withColumn("label", F.col(label).cast("int"))


def classifier(**settings: float) -> LogisticRegression:
    return LogisticRegression(labelCol="label", featuresCol="features", **({"maxIter": 20, "regParam": 0.01} | settings))


def fit(train: DataFrame, k: int = 6, **settings: float) -> PipelineModel:
    """Train on ``query_subseq`` and ``labels``.

    Features are written once, as training reads them twice.
    """
    counted = stage(with_features(train, k).select("label", "features"), "features")
    return PipelineModel([counter(k), classifier(**settings).fit(counted)])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``label``, ``logit``, ``score`` and ``prediction``."""
    k = len(model.stages[0].vocabulary[0])
    kept = [c for c in df.columns if c not in SCORED_COLUMNS]
    scored = PipelineModel(model.stages[1:]).transform(with_features(df, k))
    return scored.select(
        *kept,
        "label",
        F.get(vector_to_array("rawPrediction"), 1).alias("logit"),
        F.get(vector_to_array("probability"), 1).alias("score"),
        scores.predicted(F.get(vector_to_array("probability"), 1)).alias("prediction"),
    )


def grid(**values: Sequence[float]) -> list[dict[Param, float]]:
    """All combinations of classifier settings, such as ``regParam=[0, 0.1]``."""
    estimator, builder = classifier(), ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(estimator.getParam(name), list(options))
    return builder.build()


def tune(
    train: DataFrame, val: DataFrame, param_maps: list[dict[Param, float]], k: int = 6, parallelism: int = 4
) -> DataFrame:
    """``(params, auc)`` of every setting on the given validation split, best first.

    Features are computed once for all settings. The result has one row per setting.
    """
    spark = train.sparkSession
    train_x, val_x = (
        with_features(df, k).select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
        for df in (train, val)
    )
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    fitted = classifier().fitMultiple(train_x, param_maps)

    def one(_: int) -> tuple[int, float]:
        index, model = next(fitted)
        return index, evaluator.evaluate(model.transform(val_x))

    try:
        pool = ThreadPool(min(parallelism, len(param_maps)))
        aucs = pool.map(one, range(len(param_maps)))
        pool.close()
    finally:
        train_x.unpersist()
        val_x.unpersist()
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(param_maps[i].items(), key=lambda item: item[0].name)), auc)
        for i, auc in aucs
    ]
    return spark.createDataFrame(rows, "params string, auc double").orderBy(F.desc("auc"), "params")


def history(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """``(iteration, loss)`` of the training run."""
    losses = model.stages[-1].summary.objectiveHistory
    return spark.createDataFrame(list(enumerate(map(float, losses))), "iteration int, loss double")
