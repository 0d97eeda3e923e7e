"""BAM files as a Spark data source.

Spark plans byte ranges of the files; each task finds the first record of its range,
decodes records in Arrow batches, and checks that its last record ends where the next
range begins, so a wrong guess of a record start is an error and never a wrong result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Constants of the BAM and BGZF formats.
BAM_MAGIC = b"BAM\x01"
BGZF_MAGIC = b"\x1f\x8b\x08\x04"
BGZF_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAX_BLOCK = 1 << 16
CIGAR_CODES = "MIDNSHP=X"
SEQUENCE_CODES = "=ACMGRSVTWYHKDBN"
ON_QUERY = tuple(c in "MIS=X" for c in CIGAR_CODES)
FIXED_FIELDS = "<iiBBHHHiiii"
FIXED_SIZE = struct.calcsize(FIXED_FIELDS)
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}

SCHEMA = (
    "query_name string, flag int, reference_name string, reference_start bigint, mapping_quality int, "
    "cigar string, query_sequence string, query_length int, source_file string, read_ordinal bigint, error string"
)
COLUMNS = re.findall(r"(\w+) \w+", SCHEMA)
ARROW_SCHEMA = pa.schema(
    [(name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind])
     for name, kind in re.findall(r"(\w+) (\w+)", SCHEMA)]
)
SPLIT_BYTES = 64 << 20
BATCH_RECORDS = 4096
BATCH_BASES = 16 << 20
# A record start is believed when this many records in a row are well formed.
CHAIN = 8
LETTER_PAIRS = np.array(
    [[ord(SEQUENCE_CODES[b >> 4]), ord(SEQUENCE_CODES[b & 15])] for b in range(256)], dtype=np.uint8
)


class BamError(Exception):
    """The file is not a complete, well-formed BAM file."""


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, GCS) and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# Blocks.


def _block_size(head: bytes) -> int | None:
    """Total size of the BGZF block that starts with ``head``, or None when none does."""
    if len(head) < 18 or head[:4] != BGZF_MAGIC:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, min(12 + extra, len(head))
    while at + 4 <= end:
        length = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and length == 2 and at + 6 <= end:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


def _inflate(block: bytes) -> bytes:
    extra = struct.unpack_from("<H", block, 10)[0]
    try:
        data = zlib.decompress(block[12 + extra : -8], wbits=-15)
    except zlib.error as e:
        raise BamError(f"damaged block: {e}") from e
    crc, size = struct.unpack("<II", block[-8:])
    if len(data) != size or zlib.crc32(data) != crc:
        raise BamError("block fails its checksum")
    return data


def _blocks(file, offset: int, size: int) -> Iterator[tuple[int, bytes]]:
    """``(compressed offset, data)`` of the blocks from ``offset`` on."""
    while offset < size:
        file.seek(offset)
        raw = file.read(MAX_BLOCK)
        length = _block_size(raw)
        if length is None or len(raw) < length:
            raise BamError(f"no complete block at {offset}")
        yield offset, _inflate(raw[:length])
        offset += length


def _first_block(file, offset: int, size: int) -> int:
    """Offset of the first block at or after ``offset``; ``size`` when there is none."""
    while offset < size:
        file.seek(offset)
        raw = file.read(2 * MAX_BLOCK)
        at = raw.find(BGZF_MAGIC)
        while at >= 0:
            start = offset + at
            length = _block_size(raw[at : at + 64])
            if length is not None:
                file.seek(start)
                block = file.read(length + 64)
                follows = start + length == size or _block_size(block[length:]) is not None
                if len(block) >= length and follows:
                    try:
                        _inflate(block[:length])
                        return start
                    except (BamError, struct.error):
                        pass
            at = raw.find(BGZF_MAGIC, at + 1)
        if len(raw) < 2 * MAX_BLOCK:
            return size
        offset += len(raw) - len(BGZF_MAGIC)
    return size


# Header.


@dataclass(frozen=True)
class Header:
    names: list[str]
    lengths: list[int]
    start: int  # virtual offset of the first record


def _header(file, size: int) -> Header:
    data, origin = b"", []

    def more() -> None:
        nonlocal data
        block = next(blocks, None)
        if block is None:
            raise BamError("file ends inside the header")
        origin.append((len(data), block[0]))
        data += block[1]

    def take(n: int) -> int:
        nonlocal at
        while len(data) < at + n:
            more()
        at += n
        return at - n

    def number() -> int:
        place = take(4)
        return struct.unpack_from("<i", data, place)[0]

    blocks, at = _blocks(file, 0, size), 0
    take(len(BAM_MAGIC))
    if data[: len(BAM_MAGIC)] != BAM_MAGIC:
        raise BamError("not a BAM file")
    take(number())
    names, lengths = [], []
    for _ in range(number()):
        n = number()
        place = take(n)
        names.append(data[place : place + n - 1].decode("ascii"))
        lengths.append(number())
    block_start, coffset = next((s, c) for s, c in reversed(origin) if s <= at)
    return Header(names, lengths, coffset << 16 | at - block_start)


# Records.


def _records(blocks: Iterator[tuple[int, bytes]], skip: int) -> Iterator[tuple[int, memoryview]]:
    """``(virtual offset, record)`` from ``skip`` bytes into the first block on."""
    rest, rest_at = b"", 0
    for coffset, block in blocks:
        data, shift, pos = rest + block, len(rest), skip
        skip = 0
        view = memoryview(data)
        while len(data) - pos >= 4:
            size = struct.unpack_from("<i", data, pos)[0]
            if size < FIXED_SIZE:
                raise BamError("record is too short")
            if len(data) - pos - 4 < size:
                break
            yield (rest_at if pos < shift else coffset << 16 | pos - shift), view[pos + 4 : pos + 4 + size]
            pos += 4 + size
        if pos >= shift:
            rest_at = coffset << 16 | pos - shift
        rest = data[pos:]
    if rest:
        raise BamError("file ends inside a record")


def _plausible(data: bytes, at: int, header: Header) -> int | None:
    """Offset behind the record at ``at``; None when it is malformed, -1 when it is cut off."""
    if len(data) - at < 4 + FIXED_SIZE:
        return -1
    size = struct.unpack_from("<i", data, at)[0]
    ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from(FIXED_FIELDS, data, at + 4)
    needed = FIXED_SIZE + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    refs = len(header.names)
    if not (-1 <= ref < refs and -1 <= next_ref < refs and l_name > 0 and l_seq >= 0 and size >= needed):
        return None
    if not (-1 <= pos <= (header.lengths[ref] if ref >= 0 else 2**31 - 1) and next_pos >= -1):
        return None
    body = at + 4 + FIXED_SIZE
    name = data[body : body + l_name]
    if len(name) == l_name and (name[-1] != 0 or any(not 32 < c < 127 for c in name[:-1])):
        return None
    ops = data[body + l_name : body + l_name + 4 * n_cigar]
    if any(op & 15 >= len(CIGAR_CODES) for op in struct.unpack_from(f"<{len(ops) // 4}I", ops)):
        return None
    end = at + 4 + size
    return end if end <= len(data) else -1


def _first_record(file, offset: int, size: int, header: Header) -> int | None:
    """Virtual offset of the first record that starts in a block at or after ``offset``."""
    if offset <= header.start >> 16:
        return header.start
    start = _first_block(file, offset, size)
    while start < size:
        stream = _blocks(file, start, size)
        coffset, first = next(stream)
        data = first
        for at in range(len(first)):
            found, chain = at, 0
            while chain < CHAIN and found is not None:
                found_next = _plausible(data, found, header)
                if found_next == -1:
                    block = next(stream, None)
                    if block is None:  # at the end of the file only a whole last record will do
                        found = found if found == len(data) else None
                        break
                    data += block[1]
                    continue
                found, chain = found_next, chain + 1
            if found is not None:
                return coffset << 16 | at
        file.seek(start)
        start += _block_size(file.read(64))
    return None


def _long_cigar(record: memoryview, at: int) -> np.ndarray | None:
    """The operations of tag CG, where alignments of more than 65,535 operations keep them."""
    while at + 3 <= len(record):
        tag, kind = bytes(record[at : at + 2]), chr(record[at + 2])
        at += 3
        if kind in TAG_SIZES:
            at += TAG_SIZES[kind]
        elif kind in "ZH":
            at += bytes(record[at:]).index(0) + 1
        elif kind == "B":
            sub, n = chr(record[at]), struct.unpack_from("<i", record, at + 1)[0]
            if tag == b"CG":
                return np.frombuffer(record, "<u4", n, at + 5)
            at += 5 + n * TAG_SIZES[sub]
        else:
            raise BamError(f"unknown tag type {kind}")
    return None


def _decode(voffset: int, record: memoryview, header: Header, path: str) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, *_ = struct.unpack_from(FIXED_FIELDS, record)
    at = FIXED_SIZE
    name = bytes(record[at : at + l_name - 1]).decode("ascii")
    at += l_name
    ops = np.frombuffer(record, "<u4", n_cigar, at)
    at += 4 * n_cigar
    packed = np.frombuffer(record, np.uint8, (l_seq + 1) // 2, at)
    at += len(packed) + l_seq
    if n_cigar == 2 and ops[0] == (l_seq << 4 | 4) and ops[1] & 15 == 3:
        stored = _long_cigar(record, at)
        ops = ops if stored is None else stored
    cigar = "".join(f"{op >> 4}{CIGAR_CODES[op & 15]}" for op in ops.tolist()) or "*"
    sequence = LETTER_PAIRS[packed].tobytes()[:l_seq].decode("ascii") if l_seq else None
    contig = header.names[ref] if ref >= 0 else None
    return name, flag, contig, pos, mapq, cigar, sequence, l_seq, path, voffset, None


@dataclass
class ByteRange(InputPartition):
    path: str
    low: int
    high: int
    size: int


class BamReader(DataSourceReader):
    """``mode``: ``fail`` raises on a broken file, ``skip`` ends it quietly, ``check`` only
    reports broken files, with one row each per range."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.glob = options.get("glob", "*.bam")
        self.mode = options.get("mode", "fail")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        filesystem, folder = open_fs(self.path)
        listed = filesystem.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted(
            (f.path, f.size) for f in listed if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob)
        )
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        if not files:
            raise FileNotFoundError(f"no {self.glob} under {self.path}")
        return [
            ByteRange(scheme + path, low, min(low + self.split_bytes, size), size)
            for path, size in files
            for low in range(0, max(size, 1), self.split_bytes)
        ]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        try:
            yield from self._batches(partition)
        except (BamError, struct.error, LookupError, ValueError) as e:
            if self.mode == "fail":
                raise BamError(f"{partition.path}: {e}") from e
            if self.mode == "check":
                values = dict.fromkeys(COLUMNS) | {"source_file": partition.path, "error": str(e) or repr(e)}
                yield pa.RecordBatch.from_pylist([values], ARROW_SCHEMA)

    def _batches(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_fs(part.path)
        rows, bases = [], 0
        with filesystem.open_input_file(path) as file:
            for voffset, record, header in self._own_records(file, part):
                decoded = _decode(voffset, record, header, part.path)
                if self.mode == "check":
                    continue
                rows.append(decoded)
                bases += rows[-1][COLUMNS.index("query_length")]
                if len(rows) >= BATCH_RECORDS or bases >= BATCH_BASES:
                    yield self._batch(rows)
                    rows, bases = [], 0
        if rows:
            yield self._batch(rows)

    def _own_records(self, file, part: ByteRange) -> Iterator[tuple[int, memoryview, Header]]:
        """The records that start in this byte range."""
        if part.high == part.size:
            file.seek(max(0, part.size - len(BGZF_EOF)))
            if file.read() != BGZF_EOF:
                raise BamError("file is truncated")
        header = _header(file, part.size)
        start = _first_record(file, part.low, part.size, header)
        if start is None or start >> 16 >= part.high:
            return
        following = None
        for voffset, record in _records(_blocks(file, start >> 16, part.size), start & 0xFFFF):
            if voffset >> 16 >= part.high:
                following = voffset
                break
            yield voffset, record, header
        if part.high < part.size and following != _first_record(file, part.high, part.size, header):
            raise BamError(f"record starts do not agree at byte {part.high}")

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_SCHEMA.types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=ARROW_SCHEMA)


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)
