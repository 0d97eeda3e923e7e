"""Writing BAM files, to have something to scan in checks and tests.

BAM keeps a position in 31 bits. A contig that is longer is written in pieces, references of their own named
``contig+number``, and ``joined`` gives the records their contig and position back.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readwindows.sources import bam

#: Bases of a contig whose records start in one piece; a record may reach beyond, up to ``LENGTH``.
PIECE = 1 << 30
LENGTH = (1 << 31) - 1
CONTIGS = [(name, LENGTH) for name in ("chr1", "chr2", "chr3")]
BLOCK_BYTES = 60_000
_CODES = bytes(bam.SEQUENCE_CODES.find(chr(b)) & 0xFF for b in range(256))


def pieces(contigs: list[tuple[str, int]], count: int) -> list[tuple[str, int]]:
    """The references of a file whose contigs have ``count`` pieces: the first one has the contig's name."""
    return contigs + [(f"{name}+{i}", LENGTH) for name, _ in contigs for i in range(1, count)]


def joined(records: DataFrame) -> DataFrame:
    """Records with the contig and the position that their piece stands for."""
    number = F.coalesce(F.regexp_extract("reference_name", r"\+([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    start = F.col("reference_start") + number * PIECE
    contig = F.regexp_replace("reference_name", r"\+[0-9]+$", "")
    changed: dict[str, Column] = {"reference_start": start, "reference_name": contig}
    return records.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in records.columns])


def block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = bam.BGZF_MAGIC + bytes(6) + struct.pack("<HccHH", 6, b"B", b"C", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _packed(sequence: str) -> bytes:
    """Two letters a byte."""
    codes = np.frombuffer(sequence.encode("utf-8").translate(_CODES) + bytes(len(sequence) % 2), np.uint8)
    if codes.max(initial=0) >= len(bam.SEQUENCE_CODES):
        raise ValueError("letter without a code in BAM")
    return (codes[::2] << 4 | codes[1::2]).tobytes()


def record(name, flag, contig, start, mapq, cigar, sequence, long_cigar: bool = False, contigs=CONTIGS) -> bytes:
    names = [c for c, _ in contigs]
    if contig and start >= PIECE:
        contig, start = f"{contig}+{start // PIECE}", start % PIECE
    ops = [int(n) << 4 | bam.CIGAR_CODES.index(c) for n, c in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]
    sequence = sequence or ""
    tags = b""
    if long_cigar:
        tags = b"NMC\x01CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(sequence) << 4 | 4, 1 << 4 | 3]
    ref = names.index(contig) if contig else -1
    fixed = struct.pack(
        bam.FIXED_FIELDS, ref, start, len(name) + 1, mapq, 0, len(ops), flag, len(sequence), -1, -1, 0
    )
    body = (
        fixed
        + name.encode() + b"\0"
        + struct.pack(f"<{len(ops)}I", *ops)
        + _packed(sequence)
        + b"\xff" * len(sequence)
        + tags
    )
    return struct.pack("<i", len(body)) + body


def header(contigs=CONTIGS) -> bytes:
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", l) for n, l in contigs)
    return bam.BAM_MAGIC + struct.pack("<i", 0) + struct.pack("<i", len(contigs)) + refs


def file_blocks(records: Iterable[bytes], block_bytes: int = BLOCK_BYTES, contigs=CONTIGS) -> Iterator[bytes]:
    """The blocks of a BAM file whose records cross block borders, one at a time."""
    data = bytearray(header(contigs))
    for found in records:
        data += found
        while len(data) >= block_bytes:
            yield block(bytes(data[:block_bytes]))
            del data[:block_bytes]
    for at in range(0, len(data), block_bytes):
        yield block(bytes(data[at : at + block_bytes]))
    yield bam.BGZF_EOF


def file_bytes(records: Iterable[bytes], block_bytes: int = BLOCK_BYTES) -> bytes:
    return b"".join(file_blocks(records, block_bytes))


def write_part_files(reads: DataFrame, folder: str) -> None:
    """One BAM file per partition of ``reads``, written block by block; an action finds the pieces of its contigs."""
    last = reads.agg(F.max("reference_start")).first()[0] or 0
    contigs = pieces(CONTIGS, last // PIECE + 1)
    names = ["query_name", "flag", "reference_name", "reference_start", "mapping_quality", "cigar", "query_sequence"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = bam.open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        first = next(rows, None)
        if first is None:
            return
        made = (record(*row, contigs=contigs) for row in itertools.chain([first], rows))
        with filesystem.open_output_stream(f"{root}/part-{TaskContext.get().partitionId()}.bam") as out:
            for made_block in file_blocks(made, contigs=contigs):
                out.write(made_block)
        yield pd.DataFrame({"n": [1]})

    reads.select(*names).mapInPandas(write, "n bigint").count()
