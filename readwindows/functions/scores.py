"""Scores, predictions and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.5  # fixed value


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    """1 iff the score is strictly above the threshold."""
    return (score > threshold).cast("int")


def argmax(values: Column) -> Column:
    """Index of the largest value, the lowest on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Binary cross entropy, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
