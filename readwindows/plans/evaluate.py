"""Split tables to a trained classifier and its metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from readwindows.operators import dataset, metrics, model
from readwindows.params import Params
from readwindows.session import stage


@dataclass(frozen=True)
class Evaluation:
    fitted: PipelineModel
    history: DataFrame  # loss per iteration
    scored: DataFrame  # the evaluated split with label, logit, score and prediction
    report: DataFrame
    confusion: DataFrame
    pr_curve: DataFrame
    loss: DataFrame


def train_and_evaluate(
    splits: DataFrame, params: Params, part: str = "val", check_leakage: bool = True, **settings: float
) -> Evaluation:
    """Check the splits for leaks, train on ``train`` and evaluate on ``part``.

    Scores are written once, since several metrics read them.
    """
    if check_leakage:
        dataset.assert_no_leakage(splits)
    fitted = model.fit(dataset.part(splits, "train"), params.kmer_size, **settings)
    scored = stage(model.score(fitted, dataset.part(splits, part)), "scored")
    return Evaluation(
        fitted=fitted,
        history=model.history(fitted, splits.sparkSession),
        scored=scored,
        report=metrics.report(scored),
        confusion=metrics.confusion(scored),
        pr_curve=metrics.pr_curve(scored),
        loss=metrics.bce(scored),
    )
