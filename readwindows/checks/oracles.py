"""The registered queries as plain SQL, by the most literal route: base-level pairs, a
naive range join, and window functions over whole groups. For checks on small data.
"""

from __future__ import annotations

from readwindows import fixtures
from readwindows.checks.queries import EPOCHS, K_TRAIN, MINI_BATCHES, SETTINGS
from readwindows.functions import kmers
from readwindows.operators import training
from readwindows.operators.similarity import EDITS
from readwindows.operators.windows import SAMPLE_COLUMNS, WINDOW_KEY

P = fixtures.PARAMS
KEY = ", ".join(WINDOW_KEY)
SAMPLE = ", ".join(SAMPLE_COLUMNS)
OPS = "regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')"
PAIRED = "code IN ('M', '=', 'X')"


def digest(seed: str, *keys: str) -> str:
    return f"md5(concat_ws('-', '{seed}', {', '.join(keys)}))"


ORDER = f"{digest(str(P.seed), *WINDOW_KEY)}, {KEY}"

PARTS = {
    "reads": fixtures.ORACLE_READS,
    "peaks": fixtures.ORACLE_PEAKS,
    "scores": fixtures.ORACLE_SCORES,
    "eligible": f"""
        SELECT * FROM reads
        WHERE query_sequence IS NOT NULL AND query_sequence <> 'None'
          AND mapping_quality >= {P.min_mapping_quality} AND query_length >= {P.window_size}
          AND reference_name = '{P.contig}'""",
    "ops": f"""
        SELECT source_file, read_ordinal, reference_start, ord, right(op, 1) AS code,
          CAST(substr(op, 1, length(op) - 1) AS BIGINT) AS n
        FROM (SELECT source_file, read_ordinal, reference_start, unnest({OPS}) AS op,
                generate_subscripts({OPS}, 1) AS ord FROM reads)""",
    "blocks": f"""
        SELECT source_file, read_ordinal, p, n, q, r FROM (
          SELECT *,
            CAST(coalesce(sum(CASE WHEN {PAIRED} THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS p,
            CAST(coalesce(sum(CASE WHEN code IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER w, 0)
              AS BIGINT) AS q,
            CAST(reference_start
              + coalesce(sum(CASE WHEN code IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER w, 0)
              AS BIGINT) AS r
          FROM ops WINDOW w AS (PARTITION BY source_file, read_ordinal ORDER BY ord
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE {PAIRED}""",
    "pairs": """
        SELECT source_file, read_ordinal, p + k AS pair_index, q + k AS query_pos, r + k AS ref_pos
        FROM (SELECT *, unnest(range(n)) AS k FROM blocks)""",
    "windows": f"""
        SELECT source_file, read_ordinal, a.pair_index // {P.step_size} AS window_index,
          e.reference_name AS chromosome, e.query_name,
          a.ref_pos AS reference_start, b.ref_pos + 1 AS reference_end,
          a.query_pos AS query_start, b.query_pos + 1 AS query_end,
          substr(e.query_sequence, a.query_pos + 1, b.query_pos + 1 - a.query_pos) AS query_subseq,
          e.mapping_quality, e.query_length
        FROM eligible e JOIN pairs a USING (source_file, read_ordinal)
        JOIN pairs b USING (source_file, read_ordinal)
        WHERE a.pair_index % {P.step_size} = 0 AND b.pair_index = a.pair_index + {P.window_size - 1}
          AND b.ref_pos - a.ref_pos = {P.window_size - 1}""",
    "hits": f"""
        SELECT {KEY}, chromosome, reference_start, reference_end, peaks.*,
          least(reference_end, "end") - greatest(reference_start, start) AS overlap_bp
        FROM windows JOIN peaks
          ON chrom = chromosome AND start < reference_end AND reference_start < "end" """,
    "labelled": f"""
        SELECT windows.*, coalesce(bp, 0) AS overlap_bp,
          CAST(CASE WHEN coalesce(bp, 0) >= {P.min_overlap} THEN 1 ELSE 0 END AS INT) AS labels
        FROM windows LEFT JOIN (SELECT {KEY}, max(overlap_bp) AS bp FROM hits GROUP BY {KEY}) h
          USING ({KEY})""",
    "labelled_first": f"""
        SELECT windows.*, coalesce(bp, 0) AS overlap_bp,
          CAST(CASE WHEN coalesce(bp, 0) >= {P.min_overlap} THEN 1 ELSE 0 END AS INT) AS labels
        FROM windows LEFT JOIN (
          SELECT {KEY}, overlap_bp AS bp FROM (SELECT *, row_number() OVER (
            PARTITION BY {KEY} ORDER BY start, "end") AS rn FROM hits) WHERE rn = 1) h
          USING ({KEY})""",
    "by_file": f"""
        SELECT * EXCLUDE (rn, positives) FROM (
          SELECT *, row_number() OVER (PARTITION BY source_file, labels ORDER BY {ORDER}) AS rn,
            sum(labels) OVER (PARTITION BY source_file) AS positives FROM labelled)
        WHERE labels = 1 OR rn <= positives""",
    "uniq": f"""
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
          PARTITION BY labels, query_subseq ORDER BY {KEY}) AS rn FROM labelled) WHERE rn = 1""",
    "balanced": f"""
        SELECT * EXCLUDE (rn, positives) FROM (
          SELECT *, row_number() OVER (PARTITION BY labels ORDER BY {ORDER}) AS rn,
            sum(labels) OVER () AS positives FROM uniq)
        WHERE labels = 1 OR rn <= positives""",
    "truncated": f"""
        SELECT * REPLACE (substr(query_subseq, 1, {P.seq_len}) AS query_subseq) FROM balanced""",
}


def split_of(source: str) -> str:
    """Rows of ``source`` with their split."""
    return f"""
        SELECT * EXCLUDE (rk, n, n_val), CASE WHEN rk <= n_val THEN 'val'
          WHEN rk <= n_val + ceil({P.test_fraction}e0 * (n - n_val)) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, ceil({P.val_fraction}e0 * n) AS n_val FROM (
          SELECT *, row_number() OVER (PARTITION BY labels ORDER BY {ORDER}) AS rk,
            count(*) OVER (PARTITION BY labels) AS n FROM {source}))"""


PARTS["splits"] = split_of("truncated")
PARTS["leaky"] = split_of("labelled")
PARTS["by_score"] = """
        SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
          sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives
        FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
              FROM scores GROUP BY score)
        WINDOW w AS (ORDER BY score DESC)"""

# What each part is made from, in the order of definition.
NEEDS = {
    "eligible": ["reads"],
    "ops": ["reads"],
    "blocks": ["ops"],
    "pairs": ["blocks"],
    "windows": ["eligible", "pairs"],
    "hits": ["windows", "peaks"],
    "labelled": ["windows", "hits"],
    "labelled_first": ["windows", "hits"],
    "by_file": ["labelled"],
    "uniq": ["labelled"],
    "balanced": ["uniq"],
    "truncated": ["balanced"],
    "splits": ["truncated"],
    "leaky": ["labelled"],
    "by_score": ["scores"],
}


def sql(select: str, *parts: str, more: str = "") -> str:
    needed: list[str] = []

    def add(part: str) -> None:
        for other in NEEDS.get(part, []):
            add(other)
        if part not in needed:
            needed.append(part)

    for part in parts:
        add(part)
    ctes = [f"{name} AS ({PARTS[name]})" for name in needed]
    return f"WITH RECURSIVE {', '.join(ctes)}{more} {select}"


def kmer_id(letters: str, k: int) -> str:
    """The id of one k-mer, digit by digit."""
    value = "0"
    for j in range(1, k + 1):
        value = f"({value}) * 4 + strpos('{kmers.ALPHABET}', substr({letters}, {j}, 1)) - 1"
    known = f"regexp_full_match({letters}, '[ACGT]{{{k}}}')"
    return f"CASE WHEN {known} THEN {value} + 2 ELSE 1 END"


def kmer_list(sequence: str, k: int) -> str:
    return (
        f"list_transform(range(1, greatest(length({sequence}) - {k} + 2, 1)), "
        f"lambda i: substr({sequence}, i, {k}))"
    )


def spelled(index: str, k: int) -> str:
    return "concat(" + ", ".join(
        f"substr('{kmers.ALPHABET}', CAST(({index} // {4 ** (k - 1 - j)}) % 4 + 1 AS INT), 1)" for j in range(k)
    ) + ")"


SEQUENCES = "(SELECT read_ordinal AS doc_id, query_sequence FROM reads WHERE query_sequence IS NOT NULL)"
K = P.kmer_size
WIDTHS = f"""(SELECT CAST("end" - start AS DOUBLE) AS w FROM peaks WHERE chrom = '{P.contig}')"""
PRECISION = "tp / CAST(tp + fp AS DOUBLE)"
AP = f"round(sum(pos / CAST(positives AS DOUBLE) * ({PRECISION})), 9)"
AUC = "round(sum(pos * (negatives - fp + neg / 2e0)) / (any_value(positives) * CAST(any_value(negatives) AS DOUBLE)), 9)"
LOSS = "greatest(logit, 0e0) - logit * label + ln(1 + exp(-abs(logit)))"
TP, FP = "count(*) FILTER (label = 1 AND prediction = 1)", "count(*) FILTER (label = 0 AND prediction = 1)"
FN, TN = "count(*) FILTER (label = 1 AND prediction = 0)", "count(*) FILTER (label = 0 AND prediction = 0)"
F1 = f"round(2 * {TP} / CAST(2 * {TP} + {FP} + {FN} AS DOUBLE), 9)"
ACCURACY = "round(avg(CASE WHEN (score > 0.5e0) = (label = 1) THEN 1e0 ELSE 0e0 END), 9)"
NARROWPEAK = 'chrom, start, "end", name, score, strand, signalValue, pValue, qValue, peak'


def batch_of(source: str, order: str) -> str:
    return f"(row_number() OVER (ORDER BY {order}) - 1) // {P.batch_size}"


def trained(select: str, epochs: int, batches: int) -> str:
    """Every step of the training written out: features, logits, gradients and the optimizer, for all settings.

    Offers ``weights``, and ``reports`` with the epoch's losses, accuracies and area of every setting (s).
    """
    settings = ", ".join(f"({s}, CAST({c.learning_rate!r} AS DOUBLE), CAST({c.l2!r} AS DOUBLE))" for s, c in enumerate(SETTINGS))
    b1, b2, eps = training.BETA1, training.BETA2, training.EPSILON
    bins = training.SCORE_PARTS
    loss = "greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))"
    right = "CAST(CAST(1 / (1 + exp(-z)) > 0.5 AS INT) = y AS DOUBLE)"

    def rows(split: str) -> str:
        ids = f"list_transform({kmer_list('query_subseq', K_TRAIN)}, lambda g: {kmer_id('g', K_TRAIN)})"
        return f"""
          SELECT r, y, b, id, count(*) / CAST(any_value(n) AS DOUBLE) AS x
          FROM (SELECT r, y, b, unnest(l) AS id, len(l) AS n FROM (
            SELECT row_number() OVER (ORDER BY {KEY}) AS r, labels AS y, CAST('0x' || substr(md5('{P.seed}-' || query_subseq), 1, 8) AS BIGINT) % {batches} AS b, {ids} AS l
            FROM splits WHERE split = '{split}')) GROUP BY r, y, b, id
          UNION ALL
          SELECT row_number() OVER (ORDER BY {KEY}) AS r, labels, CAST('0x' || substr(md5('{P.seed}-' || query_subseq), 1, 8) AS BIGINT) % {batches}, -1, 1.0
          FROM splits WHERE split = '{split}'"""

    steps = [f"train_rows AS MATERIALIZED ({rows('train')})", f"val_rows AS MATERIALIZED ({rows('val')})"]
    steps.append(
        f"""w0 AS MATERIALIZED (SELECT s, rate, l2, id, 0e0 AS w, 0e0 AS m, 0e0 AS v
          FROM (VALUES {settings}) t(s, rate, l2), (SELECT unnest(range(-1, {4**K_TRAIN + kmers.FIRST_KMER_ID})) AS id))"""
    )
    t, reports = 0, []
    for epoch in range(1, epochs + 1):
        begun = t
        for b in training.batch_order(batches, P.seed, epoch):
            t += 1
            steps += [
                f"z{t} AS MATERIALIZED (SELECT s, r, y, sum(x * w) AS z FROM train_rows JOIN w{t - 1} USING (id) WHERE b = {b} GROUP BY s, r, y)",
                f"""g{t} AS MATERIALIZED (SELECT s, id, sum((1 / (1 + exp(-z)) - z{t}.y) * x) / (SELECT count(DISTINCT r) FROM z{t}) AS g
                  FROM z{t} JOIN train_rows USING (r) GROUP BY s, id)""",
                f"""w{t} AS MATERIALIZED (
                  SELECT s, rate, l2, id, w - rate * (m / (1 - {b1} ** {t})) / (sqrt(v / (1 - {b2} ** {t})) + {eps}) AS w, m, v
                  FROM (SELECT s, rate, l2, id, w, {b1} * m + (1 - {b1}) * g AS m, {b2} * v + (1 - {b2}) * g * g AS v
                    FROM (SELECT o.*, coalesce(g, 0) + CASE WHEN id = -1 THEN 0 ELSE l2 * w END AS g FROM w{t - 1} o LEFT JOIN g{t} USING (s, id))))""",
            ]
        seen = " UNION ALL ".join(f"SELECT * FROM z{u}" for u in range(begun + 1, t + 1))
        steps += [
            f"v{epoch} AS MATERIALIZED (SELECT s, r, y, sum(x * w) AS z FROM val_rows JOIN w{t} USING (id) GROUP BY s, r, y)",
            f"""a{epoch} AS (SELECT s, sum(p * (sum_n - n + n / 2e0)) / (sum(p) * sum(n)) AS auc FROM (
              SELECT s, bin, p, n, sum(n) OVER (PARTITION BY s ORDER BY bin) AS sum_n FROM (
                SELECT s, least(floor({bins} / (1 + exp(-z))), {bins - 1}) AS bin, sum(y) AS p, sum(1 - y) AS n FROM v{epoch} GROUP BY s, bin)) GROUP BY s)""",
        ]
        reports.append(
            f"""SELECT s, {epoch} AS epoch, train_loss, train_accuracy, val_loss, val_accuracy, auc FROM a{epoch}
              JOIN (SELECT s, avg({loss}) AS train_loss, avg({right}) AS train_accuracy FROM ({seen}) GROUP BY s) USING (s)
              JOIN (SELECT s, avg({loss}) AS val_loss, avg({right}) AS val_accuracy FROM v{epoch} GROUP BY s) USING (s)"""
        )
    steps.append(f"reports AS MATERIALIZED ({' UNION ALL '.join(reports)})")
    steps.append(f"weights AS (SELECT * FROM w{t})")
    # Which settings go on after each epoch: those whose best area reaches the median of the epoch.
    steps.append("live1 AS (SELECT s FROM w0 GROUP BY s)")
    for epoch in range(1, epochs):
        steps.append(
            f"""live{epoch + 1} AS (SELECT s FROM reports JOIN live{epoch} USING (s) WHERE epoch <= {epoch} GROUP BY s
              HAVING max(auc) >= (SELECT median(auc) FROM reports JOIN live{epoch} USING (s) WHERE epoch = {epoch}))"""
        )
    runs = " UNION ALL ".join(f"SELECT s, {e} AS epoch FROM live{e}" for e in range(1, epochs + 1))
    steps.append(f"runs AS MATERIALIZED ({runs})")
    return sql(select, "splits", more=", " + ", ".join(steps))


ORACLES: dict[str, str] = {
    "s1_narrowpeak_scan": sql(f"SELECT {NARROWPEAK} FROM peaks", "peaks"),
    "s2_s3_bed_round_trip": sql('SELECT chrom, start, "end" FROM peaks', "peaks"),
    "s4_sam_scan": sql("SELECT * EXCLUDE (source_file, read_ordinal) FROM reads", "reads"),
    "s4_parquet_scan": sql("SELECT * FROM reads", "reads"),
    "s4_bam_scan": sql("SELECT * EXCLUDE (source_file, read_ordinal) FROM reads", "reads"),
    "s5_file_listing": sql("SELECT source_file, count(*) AS reads FROM reads GROUP BY source_file", "reads"),
    "s6_skip_bad_file": sql(
        """SELECT source_file AS file, count(*) AS reads FROM reads
           WHERE source_file NOT IN (SELECT source_file FROM reads WHERE read_ordinal = 1)
           GROUP BY source_file""",
        "reads",
    ),
    "s7_class_samples": sql(f"SELECT {SAMPLE}, labels FROM labelled", "labelled"),
    "s7_x1_prepare_from_csv": sql("SELECT query_subseq, labels, split FROM splits", "splits"),
    "s8_combined_samples": sql(f"SELECT {SAMPLE}, labels FROM truncated", "truncated"),
    "s9_split_samples": sql("SELECT query_subseq, labels, split FROM splits", "splits"),
    "s10_s11_fasta_round_trip": sql(
        f"SELECT row_number() OVER (ORDER BY {KEY}) - 1 AS seq_id, query_subseq AS seq FROM labelled WHERE labels = 1",
        "labelled",
    ),
    "p1_bed3": sql('SELECT chrom, start, "end" FROM peaks', "peaks"),
    "p2_eligible_reads": sql("SELECT * FROM eligible", "eligible"),
    "p3_read_summary": sql(
        """SELECT reference_name AS chromosome, query_name, reference_start,
             CAST(reference_start + reference_length AS BIGINT) AS reference_end, mapping_quality, query_length,
             reference_length, flag & 16 <> 0 AS is_reverse
           FROM reads JOIN (SELECT source_file, read_ordinal,
               CAST(sum(CASE WHEN code IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) AS BIGINT) AS reference_length
             FROM ops GROUP BY ALL) o USING (source_file, read_ordinal)""",
        "reads", "ops",
    ),
    "p4_p5_contig_peak_widths": sql(
        f"""SELECT chrom AS chr_name, start AS peak_start, "end" AS peak_end, "end" - start AS peak_range
            FROM peaks WHERE chrom = '{P.contig}'""",
        "peaks",
    ),
    "p6_x2_labelled_union": sql(f"SELECT {SAMPLE}, labels FROM labelled", "labelled"),
    "p7_feature_projection": sql("SELECT query_subseq, labels FROM splits WHERE split = 'val'", "splits"),
    "p8_model_columns": sql("SELECT query_subseq AS sequence, labels AS label FROM labelled", "labelled"),
    "g1_alignment_blocks": sql("SELECT * FROM blocks", "blocks"),
    "g1_aligned_pairs": sql(
        """SELECT source_file, read_ordinal, count(*) AS pairs, CAST(sum(query_pos) AS BIGINT) AS query_sum,
             CAST(sum(ref_pos - query_pos) AS BIGINT) AS shift_sum,
             CAST(sum(pair_index * (query_pos % 1009)) AS BIGINT) AS cross_sum
           FROM pairs GROUP BY ALL""",
        "pairs",
    ),
    "g2_g3_windows": sql("SELECT * FROM windows", "windows"),
    "g4_f6_kmer_text": sql(
        f"""SELECT read_ordinal, window_index, array_to_string({kmer_list('query_subseq', K)}, ' ') AS kmer_text,
              CAST(greatest(length(query_subseq) - {K - 1}, 0) AS INT) AS kmers FROM windows""",
        "windows",
    ),
    "g5_kmer_coverage": sql(
        f"""SELECT kmer_index, kmer, coalesce(n, 0) AS n
            FROM (SELECT i AS kmer_index, {spelled('i', 3)} AS kmer FROM (SELECT unnest(range(64)) AS i)) a
            LEFT JOIN (SELECT kmer, count(*) AS n FROM (SELECT unnest({kmer_list('query_sequence', 3)}) AS kmer
              FROM {SEQUENCES}) GROUP BY kmer) s USING (kmer)""",
        "reads",
    ),
    "j1_overlap_pairs": sql("SELECT * FROM hits", "hits"),
    "j1_overlap_pairs_left": sql(
        f"""SELECT {KEY}, chromosome, reference_start, reference_end, h.chrom, h.start, h."end",
              coalesce(h.overlap_bp, 0) AS overlap_bp
            FROM windows LEFT JOIN (SELECT {KEY}, chrom, start, "end", overlap_bp FROM hits
              WHERE overlap_bp >= {P.min_overlap}) h USING ({KEY})""",
        "hits",
    ),
    "j2_labels_max": sql("SELECT * FROM labelled", "labelled"),
    "j2_labels_first": sql("SELECT * FROM labelled_first", "labelled_first"),
    # Every pair of sequences. The conditions on a pair follow from the last one (a letter put in or taken out changes one
    # letter's count and at most three counts of two letters); they only save work.
    "j3_f12_similar_pairs": sql(
        f"""SELECT a, b, round(val / CAST(greatest(length(a), length(b)) AS DOUBLE), 9) AS score
            FROM lcs WHERE done = length(a) AND col = length(b) AND val >= greatest(length(a), length(b)) - {EDITS}""",
        "windows",
        more=f""",
        seqs AS (SELECT seq, row_number() OVER (ORDER BY seq) AS id, {", ".join(f"length(seq) - length(replace(seq, '{c}', '')) AS n{c}" for c in "ACGT")},
            {", ".join(f"len(list_filter(range(1, length(seq)), lambda p: substr(seq, p, 2) = '{c}{d}')) AS n{c}{d}" for c in "ACGT" for d in "ACGT")}
          FROM (SELECT DISTINCT query_subseq AS seq FROM windows WHERE query_subseq IS NOT NULL)),
        candidates AS (
          SELECT x.id AS i, y.id AS j, x.seq AS a, y.seq AS b FROM seqs x JOIN seqs y ON x.id < y.id
          WHERE CASE WHEN abs(length(x.seq) - length(y.seq)) > {EDITS} THEN FALSE
            WHEN {" + ".join(f"abs(x.n{c} - y.n{c})" for c in "ACGT")} > 2 * {EDITS} THEN FALSE
            WHEN {" + ".join(f"abs(x.n{c}{d} - y.n{c}{d})" for c in "ACGT" for d in "ACGT")} > 6 * {EDITS} THEN FALSE
            ELSE levenshtein(x.seq, y.seq) <= 2 * {EDITS} END),
        lcs AS (
          SELECT i, j, a, b, 0 AS done, col, 0 AS val
          FROM candidates, LATERAL (SELECT unnest(range(1, length(b) + 1)) AS col) c
          UNION ALL
          SELECT i, j, a, b, done + 1, col, max(cell) OVER (PARTITION BY i, j ORDER BY col)
          FROM (SELECT *, greatest(val, lag(val, 1, 0) OVER (PARTITION BY i, j ORDER BY col)
                  + CASE WHEN substr(a, done + 1, 1) = substr(b, CAST(col AS INT), 1) THEN 1 ELSE 0 END) AS cell
                FROM lcs WHERE done < length(a)))""",
    ),
    "a1_max_overlap": sql(f"SELECT {KEY}, overlap_bp FROM labelled", "labelled"),
    "a2_peak_width_summary": sql(
        """SELECT min("end" - start) AS min_width, max("end" - start) AS max_width,
             round(median("end" - start), 9) AS median_width, round(avg("end" - start), 9) AS mean_width FROM peaks""",
        "peaks",
    ),
    "a3_peak_width_histogram": sql(
        f"""SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * (hi - lo) / 20, 9) AS bin_start,
              round(lo + (b.bin + 1) * (hi - lo) / 20, 9) AS bin_end, coalesce(n, 0) AS peaks
            FROM (SELECT unnest(range(20)) AS bin) b CROSS JOIN (SELECT min(w) AS lo, max(w) AS hi FROM {WIDTHS}) s
            LEFT JOIN (SELECT CAST(least(floor((w - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n
              FROM {WIDTHS} CROSS JOIN (SELECT min(w) AS lo, max(w) AS hi FROM {WIDTHS}) GROUP BY 1) f
              ON f.bin = b.bin""",
        "peaks",
    ),
    "a4_peak_width_density": sql(
        f"""SELECT point, round(x, 9) AS x, round(d, 9) AS density, round(d * n * (hi - lo) / 20, 6) AS count_scale
            FROM (SELECT CAST(point AS INT) AS point, x, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi,
                sum(exp(-0.5e0 * pow((x - w) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS d
              FROM (SELECT point, lo + point * (hi - lo) / 199 AS x, n, lo, hi, h
                FROM (SELECT unnest(range(200)) AS point)
                CROSS JOIN (SELECT min(w) AS lo, max(w) AS hi, count(*) AS n,
                  stddev_samp(w) * pow(count(*), -0.2e0) AS h FROM {WIDTHS}))
              CROSS JOIN {WIDTHS} GROUP BY point, x)""",
        "peaks",
    ),
    "a5_peak_width_series": sql(
        f"""SELECT peak_ordinal, peak_range FROM (SELECT chrom, row_number() OVER (ORDER BY peak_id) - 1
              AS peak_ordinal, "end" - start AS peak_range FROM peaks) WHERE chrom = '{P.contig}'""",
        "peaks",
    ),
    "a6_label_counts": sql(
        """SELECT source_file, count(*) FILTER (labels = 1) AS positive, count(*) FILTER (labels = 0) AS negative
           FROM labelled GROUP BY source_file""",
        "labelled",
    ),
    "a6_label_totals": sql(
        "SELECT count(*) FILTER (labels = 1) AS positive, count(*) FILTER (labels = 0) AS negative FROM labelled",
        "labelled",
    ),
    "a7_label_values": sql("SELECT DISTINCT labels FROM labelled", "labelled"),
    "a8_confusion_matrix": sql(
        """SELECT truth, prediction, coalesce(n, 0) AS n
           FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(truth, prediction)
           LEFT JOIN (SELECT label AS truth, prediction, count(*) AS n FROM scores GROUP BY ALL) c
             USING (truth, prediction)""",
        "scores",
    ),
    "a9_accuracy": sql(f"SELECT {ACCURACY} AS accuracy FROM scores", "scores"),
    "a10_f1": sql(f"SELECT {F1} AS f1 FROM scores", "scores"),
    "a11_pr_curve": sql(
        f"""SELECT round(score, 9) AS threshold, round({PRECISION}, 9) AS precision,
              round(tp / CAST(positives AS DOUBLE), 9) AS recall FROM by_score
            UNION ALL SELECT NULL, 1e0, 0e0""",
        "by_score",
    ),
    "a12_average_precision": sql(f"SELECT {AP} AS average_precision FROM by_score", "by_score"),
    "a13_roc_auc": sql(f"SELECT {AUC} AS roc_auc FROM by_score", "by_score"),
    "a14_bce_loss": sql(f"SELECT round(avg({LOSS}), 9) AS loss FROM scores", "scores"),
    "a15_epoch_metrics": sql(
        f"""SELECT epoch, round(avg(loss), 9) AS loss, round(avg(accuracy), 9) AS accuracy
            FROM (SELECT epoch, batch, avg({LOSS}) AS loss,
                avg(CASE WHEN (score > 0.5e0) = (label = 1) THEN 1e0 ELSE 0e0 END) AS accuracy
              FROM ({" UNION ALL ".join(
                  f"SELECT *, {e} AS epoch, "
                  f"{batch_of('scores', digest(f'{P.seed}-{e}', 'doc_id') + ', doc_id')} AS batch FROM scores"
                  for e in (0, 1))}) GROUP BY epoch, batch)
            GROUP BY epoch""",
        "scores",
    ),
    "r1_u1_make_windows": sql("SELECT * FROM by_file", "by_file"),
    "r2_balanced_sample": sql("SELECT * FROM balanced", "balanced"),
    "r3_stratified_split": sql("SELECT * FROM splits", "splits"),
    "r4_shuffled_samples": sql(
        f"SELECT *, row_number() OVER (ORDER BY {ORDER}) AS shuffle_rank FROM truncated", "truncated"
    ),
    "r5_first_windows": sql(f"SELECT * FROM windows ORDER BY {KEY} LIMIT 50", "windows"),
    "r6_ordered_batches": sql(f"SELECT {KEY}, {batch_of('labelled', KEY)} AS batch FROM labelled", "labelled"),
    "r6_shuffled_batches": sql(
        f"SELECT {KEY}, {batch_of('labelled', digest(f'{P.seed}-1', *WINDOW_KEY) + ', ' + KEY)} AS batch FROM labelled",
        "labelled",
    ),
    "x1_unique_windows": sql("SELECT * FROM uniq", "uniq"),
    "x3_leakage": sql(
        "SELECT " + ", ".join(
            f"""(SELECT count(*) FROM (SELECT query_subseq FROM leaky WHERE split = '{a}'
                 INTERSECT SELECT query_subseq FROM leaky WHERE split = '{b}')) AS {a}_{b}"""
            for a, b in (("train", "test"), ("train", "val"), ("test", "val"))
        ),
        "leaky",
    ),
    "f1_f2_truncated_sequences": sql(
        """SELECT read_ordinal, window_index, substr(query_subseq, 1, 40) AS query_subseq,
             CAST(length(substr(query_subseq, 1, 40)) AS INT) AS length FROM windows""",
        "windows",
    ),
    "f3_vocabulary_use": sql(
        f"""SELECT token_id, token, coalesce(n, 0) AS n
            FROM (SELECT 0 AS token_id, '<PAD>' AS token UNION ALL SELECT 1, '<UNK>' UNION ALL
              SELECT i + 2, {spelled('i', K)} FROM (SELECT unnest(range({4 ** K})) AS i)) v
            LEFT JOIN (SELECT token_id, count(*) AS n FROM (SELECT {kmer_id('kmer', K)} AS token_id
              FROM (SELECT unnest({kmer_list('query_sequence', K)}) AS kmer FROM {SEQUENCES})) GROUP BY token_id) u
              USING (token_id)""",
        "reads",
    ),
    "f4_kmer_ids": sql(
        f"""SELECT doc_id, array_to_string(list_transform({kmer_list('query_sequence', K)},
              lambda m: {kmer_id('m', K)}), ' ') AS ids,
              CAST(greatest(length(query_sequence) - {K - 1}, 0) AS INT) AS n FROM {SEQUENCES}""",
        "reads",
    ),
    "f5_nucleotide_ids": sql(
        f"SELECT doc_id, translate(query_sequence, 'ACGTN', '0123-') AS ids FROM {SEQUENCES}", "reads"
    ),
    "f7_padded_ids": sql(
        f"""SELECT query_subseq AS sequence, labels AS label,
              array_to_string(list_resize(list_transform({kmer_list('query_subseq', K)},
                lambda m: {kmer_id('m', K)}), {P.seq_len}, 0), ' ') AS input_ids,
              concat(repeat('1', least(length(query_subseq) - {K - 1}, {P.seq_len})),
                repeat('0', greatest({P.seq_len} - length(query_subseq) + {K - 1}, 0))) AS attention_mask
            FROM labelled""",
        "labelled",
    ),
    "f8_effective_length": sql(
        f"SELECT doc_id, CAST(length(query_sequence) - {K - 1} AS INT) AS effective_length FROM {SEQUENCES}", "reads"
    ),
    "f9_f10_predictions": sql(
        """SELECT doc_id, label, round(logit, 9) AS logit, round(1 / (1 + exp(-logit)), 9) AS score,
             CAST(CASE WHEN 1 / (1 + exp(-logit)) > 0.5e0 THEN 1 ELSE 0 END AS INT) AS prediction FROM scores""",
        "scores",
    ),
    "f11_argmax": sql(
        """SELECT doc_id, CAST(CASE WHEN -logit >= logit AND -logit >= 0 THEN 0 WHEN logit >= 0 THEN 1 ELSE 2 END
             AS INT) AS prediction FROM scores""",
        "scores",
    ),
    "u2_batched_function": sql(
        f"""SELECT doc_id, length(query_sequence) - length(replace(replace(query_sequence, 'G', ''), 'C', ''))
              AS gc_bases FROM {SEQUENCES}""",
        "reads",
    ),
    "u3_metric_report": sql(
        f"""SELECT {TP} AS tp, {FP} AS fp, {FN} AS fn, {TN} AS tn, {ACCURACY} AS accuracy, {F1} AS f1,
              any_value(ap) AS average_precision, any_value(auc) AS roc_auc
            FROM scores CROSS JOIN (SELECT {AP} AS ap, {AUC} AS auc FROM by_score)""",
        "by_score",
    ),
    "m4_training_history": trained(
        """SELECT epoch, round(train_loss, 6) AS train_loss, round(train_accuracy, 6) AS train_accuracy,
             round(val_loss, 6) AS val_loss, round(val_accuracy, 6) AS val_accuracy, round(auc, 6) AS val_auc FROM reports WHERE s = 0""",
        EPOCHS,
        MINI_BATCHES,
    ),
    "m1_m2_epoch_scores": trained(
        f"""SELECT source_file, read_ordinal, window_index, labels AS label, round(z, 6) AS logit, round(1 / (1 + exp(-z)), 6) AS score,
             CAST(1 / (1 + exp(-z)) > 0.5 AS INT) AS prediction
           FROM (SELECT *, row_number() OVER (ORDER BY {KEY}) AS r FROM splits WHERE split = 'val') JOIN (SELECT r, z FROM v{EPOCHS} WHERE s = 0) USING (r)""",
        EPOCHS,
        MINI_BATCHES,
    ),
    "m3_tuning": trained(
        f"""SELECT rate AS learning_rate, l2, CAST(epochs AS INT) AS epochs, epochs < {EPOCHS} AS pruned, round(auc, 6) AS auc,
             s = first_value(s) OVER (ORDER BY auc DESC, s) AS best
           FROM (SELECT s, any_value(rate) AS rate, any_value(l2) AS l2 FROM w0 GROUP BY s)
           JOIN (SELECT s, count(*) AS epochs, max(auc) AS auc FROM reports JOIN runs USING (s, epoch) GROUP BY s) USING (s)""",
        EPOCHS,
        MINI_BATCHES,
    ),
}
