"""WARC archives: writing with revisits, and reading by verified record boundaries.

Archives are plain text files to Spark: records end with the four bytes that the text writer
puts between lines, and reading splits files wherever the magic ``WARC/1.0`` stands, so files
of any size are read in byte ranges by many tasks. But the magic may also stand inside a payload.
So each task only emits candidates: where one starts, and where, by its length field, its
successor must start. Of these a file's true records are the ones that can be reached from
its start. They are found by pointer jumping: every round doubles the jump, so a file of n records
takes log2(n) rounds of joins for all files together. Payloads that hold the magic come in
several pieces and are put together afterwards.

Defined cases: null html is an empty payload; of equal payloads of at least ``least`` bytes the one
of the smallest page_id is the response, the others revisit it, also those of null id; all rows of
that id are responses, as is a payload that only rows of null id have; a null url writes no target
line; control characters in a url are written as %XX; extra columns are ignored; no pages make
no records. A file that doesn't begin with a record, or whose chain doesn't end at its end, raises.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readwindows.session import broadcast_up_to, scratch_path, stage

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
#: Rows of the revisit table that may be sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_REVISITS = 1_000_000
RECORDS_PER_FILE = 5_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digested(pages: DataFrame, with_payload: bool) -> DataFrame:
    columns = ["page_id", "url", "payload", "digest"] if with_payload else ["page_id", "digest", "n"]

    def run(batches):
        for batch in batches:
            payload = batch.column(2).cast(pa.binary())
            out = {"page_id": batch.column(0), "url": batch.column(1), "payload": batch.column(2)}
            out["digest"] = pa.array([base32_sha1(p.as_py()) for p in payload], pa.string())
            out["n"] = pa.array([len(p.as_buffer()) for p in payload], pa.int64())
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    types = {"page_id": "long", "url": "string", "payload": "string", "digest": "string", "n": "long"}
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    return source.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record per page, in files of at most ``RECORDS_PER_FILE`` records."""
    narrow = stage(_digested(pages, with_payload=False), "digests")
    firsts = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    revisits = narrow.join(firsts, "digest").where("first is not null and not (page_id <=> first)").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    revisits = stage(revisits, "revisits")
    revisits = broadcast_up_to(revisits, revisits.count(), BROADCAST_REVISITS)
    rows = _digested(pages, with_payload=True)
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    size = F.octet_length("payload").cast("string")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit(_HTTP), size, F.lit(BREAK))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.col("url")
    for k in (*range(0x20), 0x7F):
        url = F.replace(url, F.lit(chr(k)), F.lit(f"%{k:02X}"))
    lines = F.concat_ws(
        "\r\n",
        F.concat(F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), identity(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), identity(F.col("first")))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    writer = rows.select(F.concat(lines, F.lit(BREAK), block).alias("value")).write.option("lineSep", BREAK)
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_CHUNK = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("text", pa.string())])
_CHUNK_SQL = "file string, block long, at long, size long, text string"


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics with its place: file, byte range it was read in, and bytes since the range's first piece."""
    rows = spark.read.option("lineSep", MAGIC).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def run(batches):
        now, at = None, 0
        for batch in batches:
            places = []
            sizes = [len(v.as_buffer()) + len(MAGIC) for v in batch.column(0)]
            for key, size in zip(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), sizes, strict=True):
                if key != now:
                    now, at = key, 0
                places.append(at)
                at += size
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), batch.column(0)], schema=_CHUNK)

    return rows.mapInArrow(run, _CHUNK_SQL)


def parse(text: bytes) -> dict | None:
    """Fields of a record whose text behind the magic is given, maybe cut short; None if its header is no header."""
    head, found, rest = text.partition(BREAK.encode())
    if not found:
        return None
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields:
        return None
    total = len(head) + len(BREAK) + int(length)
    block = rest[: int(length)]
    http, _, payload = block.partition(BREAK.encode())
    sizes = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    revisit = fields["warc-type"] == "revisit"
    return {
        "bytes": total + len(MAGIC) + len(BREAK),
        "complete": len(text) >= total,
        "page_id": _page(fields.get("warc-record-id")),
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": int(sizes[0]) if revisit and sizes and sizes[0].isdigit() else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload),
        "url": fields.get("warc-target-uri"),
    }


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


_FIELDS = [("bytes", pa.int64()), ("complete", pa.bool_()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string())]
_FIELDS_SQL = "bytes long, complete boolean, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string"


def _parsed(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the record fields of each text; null fields where there is no header."""
    schema = pa.schema([*(_CHUNK.field(k) if k in _CHUNK.names else pa.field(k, pa.int64()) for k in keep), *_FIELDS])

    def run(batches):
        for batch in batches:
            fields = [parse(t.as_py()) or {} for t in batch.column("text").cast(pa.binary())]
            columns = [batch.column(k) for k in keep] + [pa.array([f.get(n) for f in fields], t) for n, t in _FIELDS]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    sql = ", ".join(f"{k} {'string' if k == 'file' else 'long'}" for k in keep)
    return chunks.mapInArrow(run, f"{sql}, {_FIELDS_SQL}")


def _placed(chunks: DataFrame, sums: DataFrame) -> DataFrame:
    """``pos``: where the magic before the text starts in its file."""
    return chunks.join(sums, ["file", "block"]).withColumn("pos", F.col("before") + F.col("at") - len(MAGIC)).drop("before")


def reachable(steps: DataFrame) -> DataFrame:
    """(file, pos) of the records on the chain from each file's start; ``steps`` is (file, pos, next)."""
    jump = steps
    reach = stage(steps.where("pos = 0").select("file", "pos"), "reach")
    while True:
        new = reach.join(jump, ["file", "pos"]).select("file", F.col("next").alias("pos"))
        reach = stage(reach.unionByName(new), "reach")
        further = jump.select("file", F.col("pos").alias("next"), F.col("next").alias("n2"))
        jump = stage(jump.join(further, ["file", "next"]).select("file", "pos", F.col("n2").alias("next")), "jump")
        if not jump.join(reach, ["file", "pos"], "left_semi").limit(1).count():
            return reach


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records: page_id, url, record_type, payload_bytes, payload_digest, refers_to."""
    chunks = _chunks(spark, path)
    found = stage(_parsed(chunks, ["file", "block", "at", "size"]), "candidates")
    ranges = found.groupBy("file", "block").agg(F.sum("size").alias("s"))
    order = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = stage(ranges.select("file", "block", before.alias("before"), (before + F.col("s") - len(MAGIC)).alias("upto")), "ranges")
    # The first text of a file stands before its first magic.
    records = stage(_placed(found, sums.drop("upto")).where("pos >= 0"), "records")
    steps = records.where("bytes is not null").select("file", "pos", (F.col("pos") + F.col("bytes")).alias("next"))
    chain = stage(reachable(steps).distinct(), "chain")
    ends = sums.groupBy("file").agg(F.max("upto").alias("pos"))
    wrong = ends.where("pos > 0").join(chain, ["file", "pos"], "left_anti").limit(3).collect()
    if wrong:
        raise ValueError(f"no unbroken chain of records: {[r.file for r in wrong]}")
    true = records.join(chain, ["file", "pos"], "left_semi")
    fields = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    out = true.where("complete").select(fields)
    broken = true.where("not complete").select("file", "pos", (F.col("pos") + F.col("bytes")).alias("next"))
    if broken.limit(1).count():
        # A record with the magic in its payload: all its pieces, in order, with the magic between them.
        last = F.last(F.when(F.col("on"), F.col("pos")), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        marks = records.select("file", "block", "at", "pos").join(chain.withColumn("on", F.lit(True)), ["file", "pos"], "left")
        owned = marks.withColumn("record", last).join(broken.select("file", F.col("pos").alias("record")), ["file", "record"], "left_semi")
        owned = stage(owned.select("file", "block", "at", "record"), "owned")
        texts = chunks.join(owned, ["file", "block", "at"]).join(sums.drop("upto"), ["file", "block"])
        pieces = texts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct((F.col("before") + F.col("at")).alias("p"), "text"))).alias("t"))
        whole = pieces.select("file", F.col("record").alias("at"), F.expr(f"concat_ws('{MAGIC.replace(chr(13), chr(92) + 'r').replace(chr(10), chr(92) + 'n')}', t.text)").alias("text"))
        out = out.unionByName(_parsed(whole, ["file", "at"]).select(fields))
    return out


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write an archive of ``pages`` into the shared folder and read it back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path)
