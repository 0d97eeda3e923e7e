"""The training-data pipeline: each stage works on all that the one before it kept.

``STAGES`` lists the stages; ``run`` applies them to ``documents`` and writes each result to
the shared folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readwindows.llm import stages
from readwindows.llm.frames import read
from readwindows.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.toxicity),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("secrets", stages.secrets),
    ("mixing", stages.mixing),
]

#: A trained classifier decides in two stages; SQL has no such thing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that the stages keep, their secrets masked, and how many words the mix takes of each (0 of some)."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
