"""FASTA files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readwindows.operators.ranking import ordered_positions


def fasta_records(df: DataFrame, order: Sequence[str], sequence: str = "query_subseq") -> DataFrame:
    """``seq_id`` (0-based row index in the stated order) and ``seq``."""
    return ordered_positions(df.select(*order, sequence), order, "seq_id").select(
        "seq_id", F.col(sequence).alias("seq")
    )


def write_fasta(
    df: DataFrame,
    path: str,
    order: Sequence[str],
    sequence: str = "query_subseq",
    mode: str = "errorifexists",
) -> None:
    """Records named by row index, one header and one sequence line each."""
    records = fasta_records(df, order, sequence)
    lines = F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), F.col("seq"))
    records.select(lines.alias("value")).write.mode(mode).text(path)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``seq_id`` and ``seq``, in splits at the mark that begins a line. Sequences may span lines."""
    record = F.split(F.regexp_replace("value", "^\\s*>", ""), "\n", 2)
    header = F.rtrim(F.get(record, 0))
    body = F.coalesce(F.get(record, 1), F.lit(""))
    return (
        spark.read.option("lineSep", "\n>")
        .text(path)
        .where(F.length(F.trim("value")) > 0)
        .select(F.get(F.split(header, r"\s"), 0).alias("seq_id"), F.regexp_replace(body, r"\s", "").alias("seq"))
    )
