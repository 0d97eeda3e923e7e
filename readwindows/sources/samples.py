"""Sample tables: window samples, combined samples and split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readwindows.operators.dataset import SPLITS, part
from readwindows.operators.windows import SAMPLE_COLUMNS, WINDOW_KEY
from readwindows.session import stage

# The columns of a window sample.
WINDOW_SAMPLES = (
    "chromosome string, query_name string, reference_start bigint, reference_end bigint, "
    "query_start bigint, query_end bigint, query_subseq string, mapping_quality int, query_length int"
)
COMBINED_SAMPLES = WINDOW_SAMPLES + ", labels int"
# A window sample followed by its key, from which a dataset can be prepared again.
KEYED_SAMPLES = WINDOW_SAMPLES + ", source_file string, read_ordinal bigint, window_index bigint"
SPLIT_SAMPLES = "query_subseq string, labels int"


def write_samples(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a sample table: Parquet, or ``csv`` with a header."""
    df.write.mode(mode).option("header", True).format(format).save(path)


def read_samples(
    spark: SparkSession, path: str, schema: str = WINDOW_SAMPLES, format: str = "parquet"
) -> DataFrame:
    reader = spark.read.option("header", True).schema(schema)
    # Null is an empty field and an empty sequence is "": a null mark unlike "" keeps them apart.
    return reader.option("nullValue", "\\N").format(format).load(path)


def write_class_samples(labelled: DataFrame, folder: str, format: str = "csv", keys: bool = False) -> None:
    """The positive and the negative windows as two tables; ``keys`` adds the key columns at the end.

    ``labelled`` is evaluated once, into a staged table.
    """
    columns = [*SAMPLE_COLUMNS, *WINDOW_KEY] if keys else SAMPLE_COLUMNS
    labelled = stage(labelled.select(*columns, "labels"), "samples")
    for name, value in (("all_p_read", 1), ("all_n_read", 0)):
        chosen = labelled.where(labelled.labels == value).select(*columns)
        write_samples(chosen, f"{folder}/{name}", format)


def write_splits(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write ``query_subseq, labels`` under one folder per split, in one job."""
    (
        df.select("query_subseq", "labels", "split")
        .write.mode(mode)
        .partitionBy("split")
        .option("header", True)
        .format(format)
        .save(path)
    )


def read_splits(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """All splits with their ``split`` column; a filter on it reads only that folder."""
    return read_samples(spark, path, SPLIT_SAMPLES + ", split string", format)


def read_split(spark: SparkSession, path: str, name: str, format: str = "parquet") -> DataFrame:
    if name not in SPLITS:
        raise ValueError(f"unknown split: {name}")
    return part(read_splits(spark, path, format), name)
