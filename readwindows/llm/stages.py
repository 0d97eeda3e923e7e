"""The stages of the pipeline: (spark, docs, sf_dir) to the documents that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readwindows.llm import decontaminate, minhash
from readwindows.llm import mixing as mix
from readwindows.llm import secrets as scan
from readwindows.llm import toxicity as tox
from readwindows.llm.frames import free_name, read
from readwindows.session import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is trained on the labelled documents of the corpus."""
    corpus, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return tox.keep_clean(docs, tox.train(corpus, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents free of benchmark passages."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked."""
    return scan.mask(docs, scan.train(read(spark, sf_dir, "documents")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each: size, source_size, target and taken, which may be 0.

    These replace columns of the same name. Rows are numbered and written first, so that each
    one gets its own back, whatever its id.
    """
    row = free_name(docs, "row")
    marked = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    mixed = mix.mix(marked, read(spark, sf_dir, "labels"), keep=[row]).drop("doc_id")
    added = [c for c in mixed.columns if c != row]
    return marked.drop(*added).join(mixed, row).drop(row)
