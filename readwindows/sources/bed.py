"""Peak and interval files: tab separated, without a header, with fixed types.

Empty lines, comments (``#``) and the display lines ``track`` and ``browser`` aren't records. A record with too
few fields, without contig, start or end, or with a field that isn't of its column's type is malformed: it
raises, or is left out with ``on_error="skip"``; ``rejects`` lists such lines. Empty fields
behind the third are null; further fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readwindows.sources.layout import or_raise

# The column layouts of the two formats.
NARROWPEAK = (
    "chrom string, start bigint, `end` bigint, name string, score int, strand string, "
    "signalValue double, pValue double, qValue double, peak int"
)
BED3 = "chrom string, start bigint, `end` bigint"
ON_ERROR = ("skip", "fail")
REQUIRED = 3


def _records(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, dict[str, Column], Column]:
    """Lines with their fields, the columns made of these, and whether a line is malformed."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    lines = lines.where(~F.rlike("value", F.lit(r"^(#|track\b|browser\b|\s*$)")))
    lines = lines.withColumn("f", F.split("value", "\t"))
    columns, broken = {}, F.lit(False)
    for place, column in enumerate(schema.split(", ")):
        name, kind = column.replace("`", "").split()
        field = F.nullif(F.get("f", place), F.lit(""))
        columns[name] = field.try_cast(kind)
        missing = F.get("f", place).isNull() if place >= REQUIRED else field.isNull()
        broken = broken | missing | (field.isNotNull() & columns[name].isNull())
    return lines, columns, broken


def _read(spark: SparkSession, path: str | list[str], schema: str, on_error: str) -> DataFrame:
    if on_error not in ON_ERROR:
        raise ValueError(f"unsupported error policy: {on_error}")
    lines, columns, broken = _records(spark, path, schema)
    if on_error == "skip":
        lines = lines.where(~broken)
    else:
        lines = lines.where(or_raise(broken, F.concat(F.lit("malformed line in "), "source_file", F.lit(": "), "value")))
    return lines.select(*[c.alias(name) for name, c in columns.items()])


def read_narrowpeak(spark: SparkSession, path: str | list[str], on_error: str = "fail") -> DataFrame:
    return _read(spark, path, NARROWPEAK, on_error)


def read_bed(spark: SparkSession, path: str | list[str], on_error: str = "fail") -> DataFrame:
    return _read(spark, path, BED3, on_error)


def rejects(spark: SparkSession, path: str | list[str], schema: str = NARROWPEAK) -> DataFrame:
    """``(source_file, line)`` of the malformed records."""
    lines, _, broken = _records(spark, path, schema)
    return lines.where(broken).select("source_file", F.col("value").alias("line"))


def write_bed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", False).csv(path)
