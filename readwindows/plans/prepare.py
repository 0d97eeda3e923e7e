"""Labelled windows to split training tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from readwindows.operators import dataset
from readwindows.params import Params
from readwindows.session import stage


@dataclass(frozen=True)
class Prepared:
    combined: DataFrame  # balanced, truncated samples with their ``shuffle_rank``
    splits: DataFrame  # the same samples with their ``split``


def prepare(
    labelled: DataFrame, params: Params, strict: bool = True, dedup_after_truncate: bool = False
) -> Prepared:
    """Dedup, balance, shuffle, truncate and split.

    Truncation comes after dedup, so it can make equal sequences again, also across
    splits; ``dedup_after_truncate`` removes them. The de-duplicated and the balanced
    table are written once each, since both are read more than once.
    """
    unique = stage(dataset.dedup(labelled), "unique")
    balanced = dataset.truncate(dataset.balance(unique, params.seed, strict), params.seq_len)
    if dedup_after_truncate:
        balanced = dataset.dedup(balanced, by=("query_subseq",))
    balanced = stage(balanced, "balanced")
    return Prepared(
        combined=dataset.shuffle(balanced, params.seed),
        splits=dataset.split(
            balanced, params.val_fraction, params.test_fraction, "labels", params.seed
        ),
    )
