"""Small DataFrame helpers of the operators."""

from __future__ import annotations

import os
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def free_name(df: DataFrame, base: str) -> str:
    """``base`` with underscores in front until no column has that name."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


def shards(df: DataFrame, column: str, target: int) -> int:
    """Partitions of some ``target`` bytes of ``column`` each, at least as many as the session's shuffles have."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(least, ceil(total / target))
