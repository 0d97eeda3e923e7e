"""One query per operator, over the whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readwindows.llm import collocations, decontaminate, extract, minhash, mixing, repeats, search, secrets, tokens, toxicity, urlfilter, warc, whitening
from readwindows.llm.frames import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words inside benchmark windows, the items found, and the verdict."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op1_decontaminate"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc_words, sizes WHERE len(w) >= n)
), found AS (
  SELECT d.doc_id, d.p, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.s = i.s
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how likely its text is marked toxic."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", predicted)


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its two-word shingles and the component of near duplicates it belongs to."""
    return minhash.membership(read(spark, sf_dir, "documents"), words=2)


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes that an earlier document has in strings of 50, and what is kept."""
    return repeats.without_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLES["op2_suffix_array_dedup"] = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
grams AS (
  SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS g
  FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 49)) AS p FROM raw WHERE len(h) >= 100)
), late AS (
  SELECT doc_id, p FROM grams JOIN (SELECT g, min(doc_id) AS first FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)) USING (g) WHERE doc_id > first
), heads AS (
  SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, TRUE) AS new FROM late
), numbered AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM heads),
spans AS (SELECT doc_id, k, min(p) AS s, max(p) + 50 AS e FROM numbered GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, k, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM spans
), cut AS (
  SELECT g.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (s - prev)), '' ORDER BY k) || substr(any_value(h), 2 * max(e) + 1) AS kept, sum(e - s) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN raw r ON g.doc_id = r.doc_id GROUP BY g.doc_id
)
SELECT r.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM raw r LEFT JOIN cut USING (doc_id)
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and how many words the mix takes of it."""
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLES["op9_mixing"] = r"""
WITH quality AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE q WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 1.0 END AS key
  FROM documents LEFT JOIN quality USING (doc_id)
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w,
    CAST(2 * sum(size) AS DOUBLE) AS cap
  FROM d GROUP BY source
), l AS (
  -- The level at which shares, cut at the caps, use up the total.
  SELECT max(level) AS level FROM (
    SELECT (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5 - coalesce((SELECT sum(b.cap) FROM s b WHERE b.cap / b.w < a.cap / a.w), 0)) / (SELECT sum(b.w) FROM s b WHERE b.cap / b.w >= a.cap / a.w) AS level, a.cap / a.w AS r FROM s a
  ) WHERE level <= r
), t AS (
  SELECT source, source_size, least(cap, coalesce(w * level, cap)) AS target FROM s, l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT doc_id, size, source_size, target, epochs, CAST(round(target) AS BIGINT) - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM o
"""


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every text, and whether the forest takes it for a secret."""
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: what its record in the archive says of its payload."""
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its url's host and path, the curated rule that fits, and the verdict."""
    return urlfilter.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text."""
    pages = read(spark, sf_dir, "pages")
    return extract.extract(pages, extract.train(pages))


@query
def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the whole text of every document whose id is divisible by 50."""
    docs = read(spark, sf_dir, "documents")
    return search.search(docs, docs.where(F.col("doc_id") % search.EVERY == 0))


@query
def op12_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: where its token ids stand in the files, how many they are, and their checksum."""
    from public_tokenizers import path

    return tokens.round_trip(read(spark, sf_dir, "documents"), path(tokens.VOCABULARY))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector and component: the whitened coordinate."""
    found = whitening.fit_and_whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: its 2,000 strongest phrases."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT lang, d, unnest(range(1, len(p) + 1)) AS k, unnest(p) AS piece
  FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents
  )
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[p:p + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM words, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
), known AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM known WHERE m > 1)
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.first JOIN known y ON y.lang = c.lang AND y.phrase = c.rest JOIN sizes s ON s.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[p:p + j - 1], ' ') AS part, max(f) AS longer
  FROM (SELECT lang, m, phrase, f, j, unnest(range(1, m - j + 2)) AS p FROM (SELECT *, unnest(range(2, m)) AS j FROM known WHERE m > 2)) GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.part = lowest.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept QUALIFY rank <= 2000
"""
