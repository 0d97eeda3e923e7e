"""Headline timings: prints one JSON line.

The reads and peaks tables are derived from the driver tables and written as Parquet
first; a timed query starts from those tables, as it would on a cluster.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows import fixtures
from readwindows.functions import kmers
from readwindows.operators import dataset, metrics, reads as read_ops, similarity, windows
from readwindows.plans.prepare import prepare
from readwindows.plans.preprocess import label_windows, make_windows
from readwindows.session import local_session, stage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
PARAMS = fixtures.PARAMS


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, 8)
    started = time.time()
    reads = stage(fixtures.reads(spark, SF_DIR), "reads")
    peaks = stage(fixtures.peaks(spark, SF_DIR), "peaks")
    scores = stage(fixtures.scores(spark, SF_DIR), "scores")
    labelled = stage(label_windows(reads, peaks, PARAMS), "labelled")
    splits = stage(prepare(labelled, PARAMS, strict=False).splits, "splits")
    prepared = time.time() - started

    def slid() -> DataFrame:
        return windows.slide(read_ops.eligible(reads, PARAMS), PARAMS.window_size, PARAMS.step_size)

    def naive_labels() -> DataFrame:
        """The plain range join on the contig, for comparison."""
        bp = F.least("reference_end", "end") - F.greatest("reference_start", "start")
        hits = (
            slid()
            .join(peaks, (F.col("chromosome") == F.col("chrom")) & (bp > 0))
            .groupBy(*windows.WINDOW_KEY)
            .agg(F.max(bp).alias("overlap_bp"))
        )
        return slid().join(hits, windows.WINDOW_KEY, "left").withColumn(
            "labels", (F.coalesce("overlap_bp", F.lit(0)) >= PARAMS.min_overlap).cast("int")
        )

    def dataset_chain() -> DataFrame:
        made = prepare(labelled, PARAMS, strict=False)
        drain(made.combined)
        return made.splits

    def encode() -> DataFrame:
        sequences = reads.where("query_sequence IS NOT NULL")
        return sequences.select("read_ordinal", kmers.encode(F.col("query_sequence"), PARAMS.kmer_size).alias("ids"))

    timed: dict[str, Callable[[], DataFrame]] = {
        "windows": slid,
        "overlap_labels": lambda: label_windows(reads, peaks, PARAMS),
        "overlap_labels_first": lambda: label_windows(reads, peaks, PARAMS, "first"),
        "overlap_labels_naive_join": naive_labels,
        "make_windows": lambda: make_windows(reads, peaks, PARAMS),
        "dedup": lambda: dataset.dedup(labelled),
        "dataset_chain": dataset_chain,
        "leakage_check": lambda: dataset.leakage(splits),
        "kmer_encode": encode,
        "pairwise_similarity_200": lambda: similarity.pairwise(labelled, windows.WINDOW_KEY, limit=200),
        "metric_report": lambda: metrics.report(scores),
    }
    seconds = {}
    for name, query in timed.items():
        best = float("inf")
        for _ in range(RUNS):
            begun = time.time()
            drain(query())
            best = min(best, time.time() - begun)
        seconds[name] = round(best, 3)
    headline = sum(v for k, v in seconds.items() if "naive" not in k)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (best of runs)",
                "value": round(headline, 3),
                "unit": "sec",
                "queries": seconds,
                "prepare_sec": round(prepared, 3),
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
