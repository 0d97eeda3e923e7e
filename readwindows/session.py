"""Session helpers: a default session, and tables staged in the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and single-node runs; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("readwindows")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # No call-site capture: it doubles the time to build long column expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The session names it in ``spark.checkpoint.dir`` (or has called
    ``setCheckpointDir``). A session on one machine without either uses a folder named after
    the application in its working directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if not re.fullmatch(r"local(\[[\d*,]+\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.abspath(os.path.join("spark-staged", sc.applicationId))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, keeps partition-dependent columns fixed, survives the loss of
    executors, and gives the planner the real size of the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Hint a broadcast when the known bound ``rows`` allows it; otherwise leave it to AQE."""
    return F.broadcast(df) if rows <= max_rows else df
