"""One query per operator, on the driver tables or on what is derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readwindows import fixtures
from readwindows.checks import bam_files
from readwindows.functions import kmers, scores
from readwindows.operators import (
    align,
    dataset,
    features,
    intervals,
    labels,
    metrics,
    model,
    peaks as peak_ops,
    ranking,
    reads as read_ops,
    similarity,
    training,
    windows,
)
from readwindows.params import Params
from readwindows.plans.evaluate import train_and_evaluate
from readwindows.plans.prepare import Prepared, prepare
from readwindows.plans.preprocess import label_windows, make_windows
from readwindows.session import scratch_path, stage
from readwindows.sources import alignments, bed, fasta, samples

Query = Callable[[SparkSession, str], DataFrame]
PARAMS = fixtures.PARAMS
QUERIES: dict[str, Query] = {}
FIRST_ROWS = 50
DIGITS = 9  # decimals of floating point results, on both sides


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(name: str) -> Column:
    return F.round(F.col(name), DIGITS).alias(name)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.slide(
        read_ops.eligible(fixtures.reads(spark, sf_dir), PARAMS), PARAMS.window_size, PARAMS.step_size
    )


def _labelled(spark: SparkSession, sf_dir: str, mode: str = "max") -> DataFrame:
    return label_windows(fixtures.reads(spark, sf_dir), fixtures.peaks(spark, sf_dir), PARAMS, mode)


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.dedup(stage(_labelled(spark, sf_dir), "labelled"))


#: What training, splits and leaks need of a labelled window.
TRAINING_COLUMNS = [*windows.WINDOW_KEY, "query_subseq", "labels"]


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled windows without the columns that training leaves unread, written once."""
    return stage(_labelled(spark, sf_dir).select(*TRAINING_COLUMNS), "labelled")


def _prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    """Not strict: on the larger tables peaks cover most of the contig and positives prevail."""
    return prepare(stage(_labelled(spark, sf_dir), "labelled"), PARAMS, strict=False)


def _training_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits of ``_prepared``, with ``TRAINING_COLUMNS`` alone."""
    return prepare(_training_rows(spark, sf_dir), PARAMS, strict=False).splits


def _with_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.reads(spark, sf_dir).where("query_sequence IS NOT NULL").select(
        F.col("read_ordinal").alias("doc_id"), "query_sequence"
    )


# Sources and sinks: written by one half, read back by the other.


@query
def s1_narrowpeak_scan(spark, sf_dir):
    path = scratch_path(spark, "narrowpeak")
    bed.write_bed(fixtures.peaks(spark, sf_dir).drop("peak_id"), path)
    return bed.read_narrowpeak(spark, path)


@query
def s2_s3_bed_round_trip(spark, sf_dir):
    path = scratch_path(spark, "bed")
    bed.write_bed(peak_ops.to_bed3(fixtures.peaks(spark, sf_dir)), path)
    return bed.read_bed(spark, path)


def _written_reads(spark, sf_dir, format):
    path = scratch_path(spark, format)
    reads = fixtures.reads(spark, sf_dir)
    if format == "sam":
        reads.select(alignments.sam_line().alias("value")).write.option("compression", "none").text(path)
        return alignments.read_alignments(spark, path, "sam", glob="part-*").drop("source_file", "read_ordinal")
    alignments.write_alignments(reads, path)
    return alignments.read_alignments(spark, path, "parquet")


@query
def s4_sam_scan(spark, sf_dir):
    return _written_reads(spark, sf_dir, "sam")


@query
def s4_parquet_scan(spark, sf_dir):
    return _written_reads(spark, sf_dir, "parquet")


@query
def s4_bam_scan(spark, sf_dir):
    path = scratch_path(spark, "bam")
    bam_files.write_part_files(fixtures.reads(spark, sf_dir), path)
    return bam_files.joined(alignments.read_alignments(spark, path, "bam")).drop("source_file", "read_ordinal")


@query
def s5_file_listing(spark, sf_dir):
    path = scratch_path(spark, "files")
    reads = fixtures.reads(spark, sf_dir).withColumn("file", F.col("source_file"))
    reads.write.partitionBy("file").parquet(path)
    return alignments.read_alignments(spark, path, "parquet").groupBy("source_file").agg(
        F.count("*").alias("reads")
    )


@query
def s6_skip_bad_file(spark, sf_dir):
    path = scratch_path(spark, "bad")
    reads = fixtures.reads(spark, sf_dir)
    line = F.when(F.col("read_ordinal") == 1, F.lit("cut\toff")).otherwise(alignments.sam_line())
    text = reads.select(F.col("source_file").alias("file"), line.alias("value"))
    text.write.partitionBy("file").text(path)
    # A folder holds the parts of one file, as many as tasks wrote to it.
    return alignments.read_alignments(spark, path, "sam", glob="part-*", on_error="skip", unit="file=[^/]+").groupBy(
        F.regexp_extract("source_file", "file=([^/]+)", 1).alias("file")
    ).agg(F.count("*").alias("reads"))


@query
def s7_class_samples(spark, sf_dir):
    path = scratch_path(spark, "classes")
    samples.write_class_samples(_labelled(spark, sf_dir), path, "csv")
    both = [samples.read_samples(spark, f"{path}/{n}", format="csv") for n in ("all_p_read", "all_n_read")]
    return dataset.combine(dataset.label(both[0], 1), dataset.label(both[1], 0))


@query
def s7_x1_prepare_from_csv(spark, sf_dir):
    path = scratch_path(spark, "handoff")
    samples.write_class_samples(_labelled(spark, sf_dir), path, "csv", keys=True)
    both = [samples.read_samples(spark, f"{path}/{n}", samples.KEYED_SAMPLES, "csv") for n in ("all_p_read", "all_n_read")]
    labelled = stage(dataset.combine(dataset.label(both[0], 1), dataset.label(both[1], 0)), "labelled")
    return prepare(labelled, PARAMS, strict=False).splits.select("query_subseq", "labels", "split")


@query
def s8_combined_samples(spark, sf_dir):
    path = scratch_path(spark, "combined")
    combined = _prepared(spark, sf_dir).combined
    samples.write_samples(combined.select(*windows.SAMPLE_COLUMNS, "labels"), path, "csv")
    return samples.read_samples(spark, path, samples.COMBINED_SAMPLES, "csv")


@query
def s9_split_samples(spark, sf_dir):
    path = scratch_path(spark, "splits")
    samples.write_splits(_training_splits(spark, sf_dir), path, "csv")
    return samples.read_splits(spark, path, "csv")


@query
def s10_s11_fasta_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    positive = _labelled(spark, sf_dir).where("labels = 1")
    fasta.write_fasta(positive, path, windows.WINDOW_KEY)
    return fasta.read_fasta(spark, path).select(F.col("seq_id").cast("bigint").alias("seq_id"), "seq")


# Projections and filters.


@query
def p1_bed3(spark, sf_dir):
    return peak_ops.to_bed3(fixtures.peaks(spark, sf_dir))


@query
def p2_eligible_reads(spark, sf_dir):
    return read_ops.eligible(fixtures.reads(spark, sf_dir), PARAMS)


@query
def p3_read_summary(spark, sf_dir):
    return read_ops.summary(fixtures.reads(spark, sf_dir))


@query
def p4_p5_contig_peak_widths(spark, sf_dir):
    return peak_ops.with_width(peak_ops.on_contig(fixtures.peaks(spark, sf_dir), PARAMS.contig))


@query
def p6_x2_labelled_union(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    classes = [labelled.where(F.col("labels") == v).select(*windows.SAMPLE_COLUMNS) for v in (1, 0)]
    return dataset.combine(dataset.label(classes[0], 1), dataset.label(classes[1], 0))


@query
def p7_feature_projection(spark, sf_dir):
    return dataset.part(_training_splits(spark, sf_dir), "val")


@query
def p8_model_columns(spark, sf_dir):
    return features.to_model_columns(_labelled(spark, sf_dir))


# Row generators.


@query
def g1_alignment_blocks(spark, sf_dir):
    return align.blocks(fixtures.reads(spark, sf_dir))


@query
def g1_aligned_pairs(spark, sf_dir):
    pairs = align.pairs(fixtures.reads(spark, sf_dir))
    return pairs.groupBy("source_file", "read_ordinal").agg(
        F.count("*").alias("pairs"),
        F.sum("query_pos").alias("query_sum"),
        F.sum(F.col("ref_pos") - F.col("query_pos")).alias("shift_sum"),
        F.sum(F.col("pair_index") * (F.col("query_pos") % 1009)).alias("cross_sum"),
    )


@query
def g2_g3_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query
def g4_f6_kmer_text(spark, sf_dir):
    return _windows(spark, sf_dir).select(
        "read_ordinal",
        "window_index",
        kmers.text(F.col("query_subseq"), PARAMS.kmer_size).alias("kmer_text"),
        F.size(kmers.split(F.col("query_subseq"), PARAMS.kmer_size)).alias("kmers"),
    )


@query
def g5_kmer_coverage(spark, sf_dir):
    """All k-mers, with how often each occurs in the reads."""
    k = 3
    seen = (
        _with_sequence(spark, sf_dir)
        .select(F.explode(kmers.split(F.col("query_sequence"), k)).alias("kmer"))
        .groupBy("kmer")
        .agg(F.count("*").alias("n"))
    )
    return features.all_kmers(spark, k).join(seen, "kmer", "left").select(
        "kmer_index", "kmer", F.coalesce("n", F.lit(0)).alias("n")
    )


# Joins.


@query
def j1_overlap_pairs(spark, sf_dir):
    return intervals.overlap_join(
        _windows(spark, sf_dir).select(*windows.WINDOW_KEY, *intervals.WINDOW_COLS),
        fixtures.peaks(spark, sf_dir),
        left_width=PARAMS.window_size,
    )


@query
def j1_overlap_pairs_left(spark, sf_dir):
    return intervals.overlap_join(
        _windows(spark, sf_dir).select(*windows.WINDOW_KEY, *intervals.WINDOW_COLS),
        peak_ops.to_bed3(fixtures.peaks(spark, sf_dir)),
        how="left",
        min_overlap=PARAMS.min_overlap,
    )


@query
def j2_labels_max(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query
def j2_labels_first(spark, sf_dir):
    return _labelled(spark, sf_dir, "first")


@query
def j3_f12_similar_pairs(spark, sf_dir):
    return similarity.near_pairs(_windows(spark, sf_dir)).select("a", "b", _rounded("score"))


# Aggregations.


@query
def a1_max_overlap(spark, sf_dir):
    return _labelled(spark, sf_dir).select(*windows.WINDOW_KEY, "overlap_bp")


@query
def a2_peak_width_summary(spark, sf_dir):
    return peak_ops.width_summary(fixtures.peaks(spark, sf_dir)).select(
        "min_width", "max_width", _rounded("median_width"), _rounded("mean_width")
    )


@query
def a3_peak_width_histogram(spark, sf_dir):
    chosen = peak_ops.on_contig(fixtures.peaks(spark, sf_dir), PARAMS.contig)
    return peak_ops.width_histogram(chosen).select("bin", _rounded("bin_start"), _rounded("bin_end"), "peaks")


@query
def a4_peak_width_density(spark, sf_dir):
    chosen = peak_ops.on_contig(fixtures.peaks(spark, sf_dir), PARAMS.contig)
    return peak_ops.width_density(chosen).select(
        "point", _rounded("x"), _rounded("density"), F.round("count_scale", 6).alias("count_scale")
    )


@query
def a5_peak_width_series(spark, sf_dir):
    return peak_ops.width_series(fixtures.peaks(spark, sf_dir), PARAMS.contig, ["peak_id"])


@query
def a6_label_counts(spark, sf_dir):
    return labels.counts(_labelled(spark, sf_dir))


@query
def a6_label_totals(spark, sf_dir):
    return labels.counts(_labelled(spark, sf_dir), by=None)


@query
def a7_label_values(spark, sf_dir):
    return dataset.label_values(_labelled(spark, sf_dir))


@query
def a8_confusion_matrix(spark, sf_dir):
    return metrics.confusion(fixtures.scores(spark, sf_dir))


@query
def a9_accuracy(spark, sf_dir):
    return metrics.accuracy(fixtures.scores(spark, sf_dir)).select(_rounded("accuracy"))


@query
def a10_f1(spark, sf_dir):
    return metrics.f1(fixtures.scores(spark, sf_dir)).select(_rounded("f1"))


@query
def a11_pr_curve(spark, sf_dir):
    return metrics.pr_curve(fixtures.scores(spark, sf_dir)).select(
        _rounded("threshold"), _rounded("precision"), _rounded("recall")
    )


@query
def a12_average_precision(spark, sf_dir):
    return metrics.average_precision(fixtures.scores(spark, sf_dir)).select(_rounded("average_precision"))


@query
def a13_roc_auc(spark, sf_dir):
    return metrics.roc_auc(fixtures.scores(spark, sf_dir)).select(_rounded("roc_auc"))


@query
def a14_bce_loss(spark, sf_dir):
    return metrics.bce(fixtures.scores(spark, sf_dir)).select(_rounded("loss"))


@query
def a15_epoch_metrics(spark, sf_dir):
    scored = fixtures.scores(spark, sf_dir)
    epochs = [
        dataset.batches(scored, PARAMS.batch_size, ["doc_id"], seed=PARAMS.seed, epoch=e).withColumn("epoch", F.lit(e))
        for e in (0, 1)
    ]
    return metrics.by_batch(epochs[0].unionByName(epochs[1])).select(
        "epoch", _rounded("loss"), _rounded("accuracy")
    )


# Sampling, ordering, splitting, set operations.


@query
def r1_u1_make_windows(spark, sf_dir):
    return make_windows(fixtures.reads(spark, sf_dir), fixtures.peaks(spark, sf_dir), PARAMS)


@query
def r2_balanced_sample(spark, sf_dir):
    return dataset.balance(stage(_unique(spark, sf_dir), "unique"), PARAMS.seed, strict=False)


@query
def r3_stratified_split(spark, sf_dir):
    return _prepared(spark, sf_dir).splits


@query
def r4_shuffled_samples(spark, sf_dir):
    return _prepared(spark, sf_dir).combined


@query
def r5_first_windows(spark, sf_dir):
    return ranking.first_rows(_windows(spark, sf_dir), windows.WINDOW_KEY, FIRST_ROWS)


@query
def r6_ordered_batches(spark, sf_dir):
    return dataset.batches(_labelled(spark, sf_dir), PARAMS.batch_size).select(*windows.WINDOW_KEY, "batch")


@query
def r6_shuffled_batches(spark, sf_dir):
    return dataset.batches(_labelled(spark, sf_dir), PARAMS.batch_size, seed=PARAMS.seed, epoch=1).select(
        *windows.WINDOW_KEY, "batch"
    )


@query
def x1_unique_windows(spark, sf_dir):
    return _unique(spark, sf_dir)


@query
def x3_leakage(spark, sf_dir):
    """Splits of the plain windows, where copies of a sequence do leak."""
    return dataset.leakage(dataset.split(_training_rows(spark, sf_dir), seed=PARAMS.seed))


# Scalar functions.


@query
def f1_f2_truncated_sequences(spark, sf_dir):
    return dataset.truncate(_windows(spark, sf_dir), 40).select(
        "read_ordinal", "window_index", "query_subseq", F.length("query_subseq").alias("length")
    )


@query
def f3_vocabulary_use(spark, sf_dir):
    """The fixed vocabulary, with how often each id occurs in the reads."""
    k = PARAMS.kmer_size
    used = features.kmer_id_counts(_with_sequence(spark, sf_dir), k, "query_sequence")
    return features.vocabulary(spark, k).join(used, "token_id", "left").select(
        "token_id", "token", F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def f4_kmer_ids(spark, sf_dir):
    ids = kmers.encode(F.col("query_sequence"), PARAMS.kmer_size)
    return _with_sequence(spark, sf_dir).select(
        "doc_id", F.array_join(ids.cast("array<string>"), " ").alias("ids"), F.size(ids).alias("n")
    )


@query
def f5_nucleotide_ids(spark, sf_dir):
    ids = kmers.nucleotides(F.col("query_sequence"), on_unknown="null")
    return _with_sequence(spark, sf_dir).select(
        "doc_id", F.array_join(ids.cast("array<string>"), "", "-").alias("ids")
    )


@query
def f7_padded_ids(spark, sf_dir):
    tokens = features.tokenized(
        features.to_model_columns(_labelled(spark, sf_dir)), PARAMS.kmer_size, PARAMS.seq_len
    )
    return tokens.select(
        "sequence",
        "label",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("attention_mask"),
    )


@query
def f8_effective_length(spark, sf_dir):
    return _with_sequence(spark, sf_dir).select(
        "doc_id",
        kmers.effective_length(F.length("query_sequence"), PARAMS.kmer_size).alias("effective_length"),
    )


@query
def f9_f10_predictions(spark, sf_dir):
    scored = fixtures.scores(spark, sf_dir).select("doc_id", "label", "logit")
    return metrics.with_prediction(metrics.with_score(scored)).select(
        "doc_id", "label", _rounded("logit"), _rounded("score"), "prediction"
    )


@query
def f11_argmax(spark, sf_dir):
    scored = fixtures.scores(spark, sf_dir)
    logits = F.array(-F.col("logit"), F.col("logit"), F.lit(0.0))
    return scored.select("doc_id", scores.argmax(logits).alias("prediction"))


# Functions over batches, reports and models.


@query
def u2_batched_function(spark, sf_dir):
    def gc_share(batch):
        upper = batch["query_sequence"].str
        batch["gc_bases"] = upper.count("G") + upper.count("C")
        return batch[["doc_id", "gc_bases"]]

    return features.map_batches(_with_sequence(spark, sf_dir), gc_share, "doc_id bigint, gc_bases bigint")


@query
def u3_metric_report(spark, sf_dir):
    names = ["accuracy", "f1", "average_precision", "roc_auc"]
    return metrics.report(fixtures.scores(spark, sf_dir)).select(
        "tp", "fp", "fn", "tn", *[_rounded(n) for n in names]
    )


def _language_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all reads, labelled by language: something a model can learn."""
    reads = fixtures.reads(spark, sf_dir).where("query_sequence IS NOT NULL")
    found = windows.slide(reads, 400, 400)
    by_contig = (F.col("chromosome") == PARAMS.contig).cast("int")
    labelled = found.withColumn("labels", by_contig).select(*TRAINING_COLUMNS)
    return stage(dataset.split(stage(labelled, "labelled"), seed=PARAMS.seed))


K_MODEL = 4
# Of the epochs and the search: small enough for the SQL to spell out every step.
K_TRAIN, EPOCHS, MINI_BATCHES = 2, 4, 2
SETTINGS = [training.Setting(0.05), training.Setting(0.01), training.Setting(0.2), training.Setting(0.2, 0.01), training.Setting(0.002, 0.1)]


@query
def m1_m2_scored_validation(spark, sf_dir):
    tables = _language_windows(spark, sf_dir)
    fitted = model.fit(dataset.part(tables, "train"), K_MODEL)
    return model.score(fitted, dataset.part(tables, "val"))


@query
def m1_u3_model_report(spark, sf_dir):
    """Train and evaluate in one call; the texts have copies, so the leak check is off."""
    tables = _language_windows(spark, sf_dir)
    return train_and_evaluate(tables, Params(kmer_size=K_MODEL), check_leakage=False).report


@query
def m3_tuning(spark, sf_dir):
    """Settings tried side by side, weak ones stopped early."""
    splits = stage(_training_splits(spark, sf_dir))
    found = training.search(dataset.part(splits, "train"), dataset.part(splits, "val"), SETTINGS, K_TRAIN, EPOCHS, MINI_BATCHES, PARAMS.seed)
    return found.withColumn("auc", F.round("auc", 6))


@query
def m4_training_history(spark, sf_dir):
    """Loss and accuracy of both tables, epoch by epoch."""
    splits = stage(_training_splits(spark, sf_dir))
    _, history = training.train(dataset.part(splits, "train"), dataset.part(splits, "val"), K_TRAIN, EPOCHS, MINI_BATCHES, SETTINGS[0].learning_rate, SETTINGS[0].l2, PARAMS.seed)
    return history.select("epoch", *[F.round(c, 6).alias(c) for c in history.columns if c != "epoch"])


@query
def m1_m2_epoch_scores(spark, sf_dir):
    """Validation windows with the scores of the classifier after the last epoch."""
    splits = stage(_training_splits(spark, sf_dir))
    fitted, _ = training.train(dataset.part(splits, "train"), dataset.part(splits, "val"), K_TRAIN, EPOCHS, MINI_BATCHES, SETTINGS[0].learning_rate, SETTINGS[0].l2, PARAMS.seed)
    scored = training.score(fitted, splits.where("split = 'val'"))
    return scored.select(*windows.WINDOW_KEY, "label", F.round("logit", 6).alias("logit"), F.round("score", 6).alias("score"), "prediction")
