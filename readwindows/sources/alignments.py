"""Aligned reads from SAM text, BAM or Parquet, all with one schema."""

from __future__ import annotations

import bz2
import gzip
import io
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from readwindows.sources.layout import or_raise

ON_ERROR = ("skip", "fail")

# The table schema, and the fields of a SAM line in order.
READS = (
    "query_name string, flag int, reference_name string, reference_start bigint, mapping_quality int, "
    "cigar string, query_sequence string, query_length int, source_file string, read_ordinal bigint"
)
READ_COLUMNS = [field.split()[0] for field in READS.split(", ")]
SAM_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
FORMATS = ("sam", "bam", "parquet")


def read_alignments(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    glob: str | None = None,
    on_error: str = "fail",
    unit: str | None = None,
) -> DataFrame:
    """All records of the files under ``path``, unmapped ones included.

    Subfolders are read as well; ``glob`` filters file names. A broken file raises. With
    ``on_error='skip'`` a SAM file with a malformed record, or a file that cannot be
    decoded whole, contributes nothing (see ``rejects``): Parquet and compressed text are
    decoded to their end by a first pass, a file to a task, and the scan is given the list of the sound ones. Parquet is the form for large tables.
    ``unit``, a regular expression, names files that belong together, such as the parts of one folder: paths
    with the same match are skipped together; a path without a match stands for itself.
    """
    if format not in FORMATS or on_error not in ON_ERROR:
        raise ValueError(f"unsupported format or error policy: {format}, {on_error}")
    glob = glob or f"*.{format}"
    if format == "bam":
        return _read_bam(spark, path, glob, on_error, unit)
    files = _files(spark, path, glob)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {glob} under {path}")
    paths = _sound(files, unit) if on_error == "skip" else [path]
    if not paths:
        return spark.createDataFrame([], READS)
    chosen = spark.read.option("recursiveFileLookup", True) if on_error == "skip" else _chosen(spark, glob)
    if format == "parquet":
        return chosen.schema(READS).parquet(*paths)
    return _read_sam(chosen.text(paths), on_error, unit)


def _chosen(spark: SparkSession, glob: str) -> DataFrameReader:
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return _chosen(spark, glob).format("binaryFile").load(path)


def _decode(name: str, data: pa.Buffer) -> None:
    """Read a Parquet or compressed file to its end; raises what is wrong with it."""
    if name.endswith(".parquet"):
        file = pq.ParquetFile(pa.BufferReader(data))
        for group in range(file.num_row_groups):
            file.read_row_group(group)
        return
    stream: io.BufferedIOBase = pa.BufferReader(data)
    opened = {"gz": gzip.open, "bz2": bz2.open}[name.rsplit(".", 1)[1]](stream)
    while opened.read(1 << 20):
        pass


def _probed(files: DataFrame) -> DataFrame:
    """``(source_file, error)`` of the Parquet and compressed files that can't be decoded."""

    def run(batches):
        for batch in batches:
            found = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    _decode(name, content.as_buffer())
                except Exception as error:  # whatever a damaged file makes a decoder raise
                    found.append((name, f"{type(error).__name__}: {error}"[:500]))
            columns = [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["source_file", "error"])

    compressed = files.where(F.rlike("path", F.lit(r"\.(parquet|gz|bz2)$")))
    return compressed.select("path", "content").mapInArrow(run, "source_file string, error string")


def _sound(files: DataFrame, unit: str | None = None) -> list[str]:
    """The files that a scan may be given: a list as long as the one that the scan makes of a folder."""

    def whole(path: str) -> str:
        found = re.search(unit, path) if unit else None
        return found[0] if found and found[0] else path

    broken = {whole(r.source_file) for r in _probed(files).select("source_file").collect()}
    return [r.path for r in files.select("path").collect() if whole(r.path) not in broken]


def _without(rows: DataFrame, bad: DataFrame, unit: str | None) -> DataFrame:
    """The rows of files that share no unit with a file of ``bad``."""
    path = F.col("source_file")
    whole = F.coalesce(F.nullif(F.regexp_extract(path, unit, 0), F.lit("")), path) if unit else path
    broken = bad.select(whole.alias("_unit")).distinct()
    return rows.withColumn("_unit", whole).join(broken, "_unit", "left_anti").select(*rows.columns)


def rejects(spark: SparkSession, path: str, format: str, glob: str | None = None) -> DataFrame:
    """``(source_file, error)``: the files that ``on_error='skip'`` leaves out."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    glob = glob or f"*.{format}"
    if format == "bam":
        found = _scan_bam(spark, path, glob, "check")
    else:
        files = _files(spark, path, glob)
        found = _probed(files)
        sound = _sound(files) if format == "sam" else []
        if sound:
            lines, broken = _sam_fields(spark.read.text(sound))
            error = F.concat(F.lit("malformed record of "), F.coalesce("qname", F.lit("no name")))
            found = found.unionByName(lines.where(broken).select("source_file", error.alias("error")))
    return found.groupBy("source_file").agg(F.min("error").alias("error"))


def _read_sam(text: DataFrame, on_error: str, unit: str | None = None) -> DataFrame:
    """SAM text as column expressions, in as many splits as the files have.

    ``read_ordinal`` is the split's byte offset plus the row's place among the rows its
    task reads. A task reads no more rows than a split has bytes, so ordinals are unique
    in a file and follow file order.
    """
    lines, broken = _sam_fields(text)
    numbers = _sam_numbers()
    if on_error == "skip":
        lines = _without(lines, lines.where(broken), unit)
    else:
        # A filter, so that no choice of columns prunes the check away.
        lines = lines.where(or_raise(broken, F.concat(F.lit("malformed record in "), "source_file")))
    sequence = F.nullif("seq", F.lit("*"))
    return lines.select(
        F.col("qname").alias("query_name"),
        numbers["flag"].cast("int").alias("flag"),
        F.nullif("rname", F.lit("*")).alias("reference_name"),
        (numbers["pos"] - 1).alias("reference_start"),
        numbers["mapq"].cast("int").alias("mapping_quality"),
        "cigar",
        sequence.alias("query_sequence"),
        F.coalesce(F.length(sequence), F.lit(0)).alias("query_length"),
        "source_file",
        "read_ordinal",
    )


def _sam_numbers() -> dict[str, Column]:
    return {name: F.col(name).try_cast("bigint") for name in ("flag", "pos", "mapq")}


def _sam_fields(text: DataFrame) -> tuple[DataFrame, Column]:
    """The records' fields, and whether a record is malformed."""
    fields = F.split("value", "\t", 12)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = (
        text.select(
            "value",
            F.col("_metadata.file_path").alias("source_file"),
            (F.col("_metadata.file_block_start") + row).alias("read_ordinal"),
        )
        .where(~F.startswith("value", F.lit("@")) & (F.col("value") != ""))
        .select("source_file", "read_ordinal", fields.alias("f"))
        .select(
            "source_file",
            "read_ordinal",
            *[F.get("f", i).alias(name) for i, name in enumerate(SAM_FIELDS)],
        )
    )
    numbers = _sam_numbers()
    broken = F.col("qual").isNull() | numbers["flag"].isNull() | numbers["pos"].isNull() | numbers["mapq"].isNull()
    return lines, broken


def _scan_bam(spark: SparkSession, path: str, glob: str, mode: str) -> DataFrame:
    from readwindows.sources.bam import BamDataSource

    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").option("glob", glob).option("mode", mode).load(path)


def _read_bam(spark: SparkSession, path: str, glob: str, on_error: str, unit: str | None = None) -> DataFrame:
    records = _scan_bam(spark, path, glob, "fail" if on_error == "fail" else "skip").drop("error")
    if on_error == "fail":
        return records
    # The check decodes every record, as the scan does; the scan is quiet on a broken file, which leaves whole.
    return _without(records, _scan_bam(spark, path, glob, "check"), unit).select(*READ_COLUMNS)


def write_alignments(reads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The Parquet form, in ranges of (contig, position), so that filters skip row groups."""
    ordered = reads.repartitionByRange("reference_name", "reference_start", "source_file", "read_ordinal")
    ordered.sortWithinPartitions("reference_name", "reference_start").write.mode(mode).parquet(path)


def sam_line() -> Column:
    """A read as a SAM line without the optional fields."""
    return F.concat_ws(
        "\t",
        "query_name",
        F.col("flag").cast("string"),
        F.coalesce("reference_name", F.lit("*")),
        (F.col("reference_start") + 1).cast("string"),
        F.col("mapping_quality").cast("string"),
        "cigar",
        F.lit("*"),
        F.lit("0"),
        F.lit("0"),
        F.coalesce("query_sequence", F.lit("*")),
        F.lit("*"),
    )
