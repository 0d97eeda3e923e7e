"""Partition layout and checks of scanned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that cannot be split enough to occupy the cluster.

    One small file, one Parquet row group or one compressed text file is a single task.
    A scan with enough splits, as any large table has, is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def or_raise(broken: Column, message: Column) -> Column:
    """A filter that all rows pass; it raises at a broken one."""
    return F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True)
