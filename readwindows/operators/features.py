"""Model inputs from sequence tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readwindows.functions import kmers


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    """All 4^k k-mers with their lexicographic index, from 0."""
    return spark.range(4**k).select(F.col("id").alias("kmer_index"), kmers.spelled(F.col("id"), k).alias("kmer"))


def vocabulary(spark: SparkSession, k: int) -> DataFrame:
    """Tokens and ids: padding, unknown, then the k-mers in order."""
    reserved = spark.range(kmers.FIRST_KMER_ID).select(
        F.when(F.col("id") == kmers.PAD_ID, kmers.PAD).otherwise(kmers.UNKNOWN).alias("token"),
        F.col("id").alias("token_id"),
    )
    known = all_kmers(spark, k).select(
        F.col("kmer").alias("token"), (F.col("kmer_index") + kmers.FIRST_KMER_ID).alias("token_id")
    )
    return reserved.unionByName(known)


def with_kmer_ids(df: DataFrame, k: int, sequence: str = "query_subseq") -> DataFrame:
    return df.withColumn("input_ids", kmers.encode(F.col(sequence), k))


def kmer_id_counts(df: DataFrame, k: int, sequence: str = "query_subseq") -> DataFrame:
    """``(token_id, n)``: how often each id occurs.

    A task counts the ids of a few megabytes of letters at a time, and sends one row for each id of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _ in kmers.id_blocks(batch.column(0), k):
                found, n = np.unique(ids, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["token_id", "n"])

    counted = df.select(sequence).mapInArrow(run, "token_id bigint, n bigint")
    return counted.groupBy("token_id").agg(F.sum("n").alias("n"))


def to_model_columns(df: DataFrame) -> DataFrame:
    """``sequence`` and an integer ``label``."""
    return df.select(F.col("query_subseq").alias("sequence"), F.col("labels").cast("int").alias("label"))


def tokenized(df: DataFrame, k: int, n: int) -> DataFrame:
    """Fixed-length k-mer ids with their mask, next to the model columns."""
    ids = kmers.encode(F.col("sequence"), k)
    return (
        df.withColumn("_ids", ids)
        .withColumn("input_ids", kmers.pad(F.col("_ids"), n))
        .withColumn("attention_mask", kmers.mask(F.col("_ids"), n))
        .drop("_ids")
    )


def map_batches(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply ``function`` to Arrow batches of the table, for what has no column function."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(function, batches)

    return df.mapInPandas(over, schema)
