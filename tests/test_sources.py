import bz2
import gzip
import os
import random

import pytest
from helpers import READ_SCHEMA, read
from pyspark.sql import functions as F

from readwindows.checks import bam_files
from readwindows.operators import dataset
from readwindows.sources import alignments, bam, bed, fasta, samples


def reads(n, seed=4, longest=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sequence = "".join(rng.choices("ACGTN", k=rng.randint(1, longest)))
        if i % 10 == 9:
            rows.append((f"r{i}", 4, None, -1, 0, "*", None, 0))
        else:
            cigar = f"{len(sequence)}M" if len(sequence) < 9 else f"3S{len(sequence) - 8}M2I7D3="
            rows.append((f"r{i}", 16 * (i % 2), f"chr{1 + i % 3}", rng.randint(0, 10**6), i % 61, cigar, sequence, len(sequence)))
    return rows


def encoded(rows, **kw):
    return [bam_files.record(*r[:7], **kw) for r in rows]


def plain(df):
    return sorted(tuple(r)[:8] for r in df.drop("source_file", "read_ordinal").collect())


def key(rows):
    return sorted(tuple(r) for r in rows)


def compare(found, rows):
    assert sorted(map(repr, plain_rows(found))) == sorted(map(repr, rows))


def plain_rows(df):
    return [tuple(r) for r in df.drop("source_file", "read_ordinal").collect()]


def test_bam_files(spark, tmp_path):
    a, b = reads(300, 1), reads(200, 2)
    (tmp_path / "a.bam").write_bytes(bam_files.file_bytes(encoded(a)))
    (tmp_path / "b.bam").write_bytes(bam_files.file_bytes(encoded(b), block_bytes=500))
    (tmp_path / "header.bam").write_bytes(bam_files.file_bytes([]))
    (tmp_path / "note.txt").write_text("not a bam file")
    for policy in alignments.ON_ERROR:
        df = alignments.read_alignments(spark, str(tmp_path), "bam", on_error=policy)
        compare(df, a + b)
        assert [f.simpleString() for f in df.schema] == [f.simpleString() for f in spark.createDataFrame([], READ_SCHEMA).schema]
    df = alignments.read_alignments(spark, str(tmp_path), "bam", glob="a.bam")
    compare(df, a)
    ordered = df.orderBy("source_file", "read_ordinal").collect()
    assert [r.query_name for r in ordered] == [r[0] for r in a]


@pytest.mark.parametrize("block_bytes", [700, 60_000])
@pytest.mark.parametrize("split_bytes", [1_000, 33_333, 10**9])
def test_bam_splits_find_every_record_once(tmp_path, split_bytes, block_bytes):
    rows = reads(400, 3, longest=2500)
    (tmp_path / "a.bam").write_bytes(bam_files.file_bytes(encoded(rows), block_bytes))
    options = {"path": str(tmp_path), "split_bytes": str(split_bytes)}
    reader = bam.BamReader(options)
    found = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert [r["query_name"] for r in found] == [r[0] for r in rows]
    ordinals = [r["read_ordinal"] for r in found]
    assert ordinals == sorted(set(ordinals))


def test_bam_record_longer_than_blocks_and_long_cigar(tmp_path):
    sequence = "".join(random.Random(1).choices("ACGT", k=300_000))
    cigar = "2M1I" * 100_000
    rows = [("long", 0, "chr1", 5, 60, cigar, sequence, len(sequence))]
    (tmp_path / "a.bam").write_bytes(bam_files.file_bytes(encoded(rows, long_cigar=True) + encoded(reads(5))))
    for split in (20_000, 10**9):
        reader = bam.BamReader({"path": str(tmp_path), "split_bytes": str(split)})
        found = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        assert len(found) == 6 and found[0]["cigar"] == cigar and found[0]["query_sequence"] == sequence


def test_broken_bam_files_are_skipped_whole(spark, tmp_path):
    good, other = reads(100, 1), reads(150, 2)
    whole = bam_files.file_bytes(encoded(other), block_bytes=3000)
    damaged = bytearray(whole)
    damaged[len(whole) // 2] ^= 255
    (tmp_path / "good.bam").write_bytes(bam_files.file_bytes(encoded(good)))
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "no_end.bam").write_bytes(whole[: -len(bam.BGZF_EOF)])
    (tmp_path / "damaged.bam").write_bytes(bytes(damaged))
    (tmp_path / "empty.bam").write_bytes(b"")
    # Whole blocks, but one record of the last ones names an unknown contig.
    odd = encoded(other)
    odd[120] = odd[120][:4] + (99).to_bytes(4, "little") + odd[120][8:]
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "odd.bam").write_bytes(bam_files.file_bytes(odd, block_bytes=3000))
    (tmp_path / "below" / "more.bam").write_bytes(bam_files.file_bytes(encoded(good)))
    compare(alignments.read_alignments(spark, str(tmp_path), "bam", on_error="skip"), good + good)
    bad = alignments.rejects(spark, str(tmp_path), "bam").collect()
    assert sorted(r.source_file.rsplit("/", 1)[1] for r in bad) == ["cut.bam", "damaged.bam", "empty.bam", "no_end.bam", "odd.bam"]
    assert all(r.error for r in bad)
    with pytest.raises(Exception, match="BamError"):
        alignments.read_alignments(spark, str(tmp_path), "bam").collect()


def test_damaged_parquet_and_compressed_text_raise(spark, tmp_path):
    rows = [read(i, "4M", "ACGT", start=i) for i in range(2000)]
    df = spark.createDataFrame(rows, READ_SCHEMA).coalesce(1)
    df.write.parquet(str(tmp_path / "p"))
    df.select(alignments.sam_line().alias("value")).write.option("compression", "gzip").text(str(tmp_path / "s"))
    for folder, format, glob in (("p", "parquet", "*.parquet"), ("s", "sam", "*.gz")):
        part = next((tmp_path / folder).glob("part-*"))
        whole = part.read_bytes()
        (tmp_path / folder / f".{part.name}.crc").unlink()
        part.write_bytes(whole[: len(whole) // 2] if format == "sam" else whole[:200] + bytes(200) + whole[400:])
        with pytest.raises(Exception):
            alignments.read_alignments(spark, str(tmp_path / folder), format, glob).collect()
        assert alignments.read_alignments(spark, str(tmp_path / folder), format, glob, "skip").count() == 0


def sam_text(rows):
    lines = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:250000000"]
    for name, flag, contig, start, mapq, cigar, sequence, _ in rows:
        fields = [name, flag, contig or "*", start + 1, mapq, cigar, "*", 0, 0, sequence or "*", "*", "NM:i:1", "XX:Z:t"]
        lines.append("\t".join(map(str, fields)))
    return "\n".join(lines) + "\n"


def test_sam_files(spark, tmp_path):
    a, b = reads(300, 1), reads(50, 2)
    (tmp_path / "a.sam").write_text(sam_text(a))
    (tmp_path / "b.sam").write_text(sam_text(b))
    (tmp_path / "header.sam").write_text("@HD\tVN:1.6\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        df = alignments.read_alignments(spark, str(tmp_path), "sam")
        assert df.rdd.getNumPartitions() > 4
        compare(df, a + b)
        in_a = df.where("source_file like '%a.sam'").orderBy("read_ordinal").collect()
        assert [r.query_name for r in in_a] == [r[0] for r in a]
        assert len({r.read_ordinal for r in in_a}) == len(a)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "c.sam").write_text(sam_text(b)[:-200].rsplit("\t", 5)[0])
    compare(alignments.read_alignments(spark, str(tmp_path), "sam", on_error="skip"), a + b)
    assert [r.source_file.rsplit("/", 1)[1] for r in alignments.rejects(spark, str(tmp_path), "sam").collect()] == ["c.sam"]
    with pytest.raises(Exception, match="malformed"):
        alignments.read_alignments(spark, str(tmp_path), "sam", on_error="fail").collect()
    compare(alignments.read_alignments(spark, str(tmp_path), "sam", glob="a.sam"), a)


def test_parquet_and_errors(spark, tmp_path):
    rows = [read(i, "4M", "ACGT", start=1000 - i) for i in range(20)]
    df = spark.createDataFrame(rows, READ_SCHEMA)
    alignments.write_alignments(df, str(tmp_path / "reads"))
    back = alignments.read_alignments(spark, str(tmp_path / "reads"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(FileNotFoundError):
        alignments.read_alignments(spark, str(tmp_path / "reads"), "sam")
    with pytest.raises(ValueError):
        alignments.read_alignments(spark, str(tmp_path), "cram")


def test_peak_files(spark, tmp_path):
    path = tmp_path / "peaks.narrowPeak"
    path.write_text("chr1\t10\t200\tp1\t5\t.\t1.5\t-1\t2.25\t30\nchr2\t0\t9\tp2\t0\t+\t0\t0\t0\t-1\n")
    df = bed.read_narrowpeak(spark, str(path))
    assert df.first().signalValue == 1.5 and df.count() == 2
    bed.write_bed(df.select("chrom", "start", "end"), str(tmp_path / "bed"))
    assert sorted(map(tuple, bed.read_bed(spark, str(tmp_path / "bed")).collect())) == [("chr1", 10, 200), ("chr2", 0, 9)]
    text = "".join((tmp_path / "bed" / f).read_text() for f in os.listdir(tmp_path / "bed") if f.startswith("part"))
    assert "chr1\t10\t200\n" in text and "chrom" not in text


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1 first x>y\nACGT\nAC\n>s2\nGG\n\n>s3\n")
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "x.fa")).collect())) == [
        ("s1", "ACGTAC"), ("s2", "GG"), ("s3", "")]
    df = spark.createDataFrame([(3, "CC"), (1, "AA"), (2, "GG")], "k int, query_subseq string")
    fasta.write_fasta(df, str(tmp_path / "out"), ["k"])
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "out")).collect())) == [
        ("0", "AA"), ("1", "GG"), ("2", "CC")]


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_sample_files(spark, tmp_path, format):
    rows = [("ACGT", 1, "train"), ("", 0, "train"), ("GG", 1, "val"), ("TT", 0, "test")]
    df = spark.createDataFrame(rows, "query_subseq string, labels int, split string")
    samples.write_splits(df, str(tmp_path / "s"), format)
    back = samples.read_splits(spark, str(tmp_path / "s"), format)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert samples.read_split(spark, str(tmp_path / "s"), "train", format).count() == 2
    assert set(os.listdir(tmp_path / "s")) >= {f"split={s}" for s in dataset.SPLITS}
    with pytest.raises(ValueError):
        samples.read_split(spark, str(tmp_path / "s"), "dev", format)


@pytest.mark.parametrize(
    "asked",
    [
        lambda df: df.count(),
        lambda df: df.select("query_name").collect(),
        lambda df: df.where("query_name = 'r1'").collect(),
        lambda df: df.where("flag > 3").select("flag").collect(),
        lambda df: df.groupBy("reference_name").count().collect(),
        lambda df: df.where("query_name = 'nobody'").count(),
    ],
)
def test_sam_raises_whatever_is_read(spark, tmp_path, asked):
    good = "\t".join(["r1", "0", "chr1", "5", "60", "3M", "*", "0", "0", "ACG", "*"])
    (tmp_path / "a.sam").write_text(f"@HD\n{good}\n")
    asked(alignments.read_alignments(spark, str(tmp_path), "sam"))
    (tmp_path / "b.sam").write_text(f"{good}\ncut\toff\n{good}\n")
    with pytest.raises(Exception, match="malformed record"):
        asked(alignments.read_alignments(spark, str(tmp_path), "sam"))


def test_malformed_peak_lines(spark, tmp_path):
    good = ["chr1", "5", "90", "p1", "7", ".", "1.5", "2", "-1", "30"]
    lines = ["track name=x", "browser position chr1", "# note", "", "  ", "\t".join(good), "\t".join([*good, "more"]), "\t".join([*good[:3], *[""] * 7])]
    broken = ["chr1\t5", "\t".join(["chr1", "five", *good[2:]]), "\t".join(["", *good[1:]]), "\t".join([*good[:4], "7.5", *good[5:]]), "trackless\tx"]
    path = tmp_path / "a.narrowPeak"
    path.write_text("\n".join(lines) + "\n")
    whole = ("chr1", 5, 90, "p1", 7, ".", 1.5, 2.0, -1.0, 30)
    expected = sorted([whole, whole, ("chr1", 5, 90) + (None,) * 7], key=str)
    assert sorted(map(tuple, bed.read_narrowpeak(spark, str(path)).collect()), key=str) == expected
    assert bed.rejects(spark, str(path)).collect() == []
    path.write_text("\n".join(lines + broken))
    for asked in (lambda df: df.count(), lambda df: df.select("chrom").collect(), lambda df: df.where("score > 900").count()):
        with pytest.raises(Exception, match="malformed line"):
            asked(bed.read_narrowpeak(spark, str(path)))
    assert sorted(map(tuple, bed.read_narrowpeak(spark, str(path), "skip").collect()), key=str) == expected
    assert sorted(r.line for r in bed.rejects(spark, str(path)).collect()) == sorted(broken)
    assert len(bed.rejects(spark, str(path), bed.BED3).collect()) == 4
    with pytest.raises(ValueError, match="policy"):
        bed.read_bed(spark, str(path), "ignore")


@pytest.mark.parametrize("format,ending", [("parquet", "parquet"), ("sam", "sam.gz"), ("sam", "sam.bz2")])
def test_damaged_files_leave_whole(spark, tmp_path, format, ending):
    folder = tmp_path / "reads"
    folder.mkdir()
    a, b = reads(400, 1, 300), reads(300, 2, 300)
    pack = {"gz": gzip.compress, "bz2": bz2.compress}.get(ending.rsplit(".", 1)[-1])
    for name, rows in (("a", a), ("b", b)):
        if format == "sam":
            data = pack(sam_text(rows).encode())
        else:
            table = [(*r, "f", i) for i, r in enumerate(rows)]
            spark.createDataFrame(table, READ_SCHEMA).coalesce(1).write.option("parquet.block.size", 20_000).parquet(str(tmp_path / name))
            data = next((tmp_path / name).glob("part-*")).read_bytes()
        (folder / f"{name}.{ending}").write_bytes(data)
        # Sound rows before the damage: the tail is lost, or bytes in the middle are wrong.
        (folder / f"cut{name}.{ending}").write_bytes(data[: len(data) * 2 // 3])
        middle = len(data) // 2
        (folder / f"hurt{name}.{ending}").write_bytes(data[:middle] + bytes(x ^ 0x5A for x in data[middle : middle + 200]) + data[middle + 200 :])
    glob = f"*.{ending}"
    compare(alignments.read_alignments(spark, str(folder), format, glob, "skip"), a + b)
    bad = alignments.rejects(spark, str(folder), format, glob).collect()
    assert sorted(r.source_file.rsplit("/", 1)[1].split(".")[0] for r in bad) == ["cuta", "cutb", "hurta", "hurtb"]
    assert all(r.error for r in bad)
    with pytest.raises(Exception):
        alignments.read_alignments(spark, str(folder), format, glob).agg(*[F.max(c) for c in alignments.READ_COLUMNS]).collect()
    for name in ("a", "b"):
        (folder / f"{name}.{ending}").unlink()
    assert alignments.read_alignments(spark, str(folder), format, glob, "skip").count() == 0


def test_positions_beyond_the_range_of_bam(spark, tmp_path):
    starts = [0, (1 << 30) - 1, 1 << 30, 3_000_000_000, 20_000_000_000]
    rows = [read(i, "4M", "ACGT" if i % 2 else "ACGTN", start, f"chr{1 + i % 3}") for i, start in enumerate(starts)]
    df = spark.createDataFrame(rows, READ_SCHEMA).repartition(3)
    bam_files.write_part_files(df, str(tmp_path))
    found = bam_files.joined(alignments.read_alignments(spark, str(tmp_path), "bam"))
    columns = ["query_name", "reference_name", "reference_start", "query_sequence"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, df.select(*columns).collect()))


def test_bam_files_of_partitions_that_begin_alike(spark, tmp_path):
    df = spark.createDataFrame([read(1, "4M", "ACGT")] * 8, READ_SCHEMA).repartition(4)
    bam_files.write_part_files(df, str(tmp_path))
    assert alignments.read_alignments(spark, str(tmp_path), "bam").count() == 8


def test_parts_of_one_unit_are_skipped_together(spark, tmp_path):
    def line(n):
        return f"r{n}\t0\tchr1\t1\t60\t4M\t*\t0\t0\tACGT\t*\n"

    for folder, name, text in (("file=a", "part-0", line(0)), ("file=a", "part-1", "cut\toff\n"), ("file=b", "part-0", line(1)), ("file=b", "part-1", line(2)), (".", "part-2", line(3))):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    read_all = lambda **kw: sorted(r[0] for r in alignments.read_alignments(spark, str(tmp_path), "sam", "part-*", "skip", **kw).select("query_name").collect())
    assert read_all() == ["r0", "r1", "r2", "r3"]
    assert read_all(unit="file=[^/]+") == ["r1", "r2", "r3"]
