"""Reads, peaks and scores derived from the driver tables, for Spark and for the check SQL.

The same select list serves both engines. The letter filter is spelled differently, and in Spark the sequence comes from a
generator of one row: filters on it would otherwise each repeat its whole expression below the projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readwindows.params import Params
from readwindows.sources.layout import spread

# The published parameters scaled down to the length of the test texts.
PARAMS = Params(window_size=50, step_size=50, min_overlap=25, seq_len=50)

_STRIP_SPARK = "regexp_replace(text, '[^A-Za-z]', '')"
_STRIP_ORACLE = "regexp_replace(text, '[^A-Za-z]', '', 'g')"

_SEQUENCE = """TRANSLATE(LOWER({strip}), 'abcdefghijklmnopqrstuvwxyz',
                                  'ACGTACGTACGTACGTACGTACGTAN')"""

_READS = """
SELECT CONCAT('read', doc_id) AS query_name,
  CAST(CASE WHEN doc_id % 2 = 0 THEN 16 ELSE 0 END AS INT) AS flag,
  CASE lang WHEN 'en' THEN 'chr1' WHEN 'fr' THEN 'chr2' ELSE 'chr3' END AS reference_name,
  (doc_id * 7919) % 5000000 + CAST(FLOOR(doc_id / 1000) AS BIGINT) * 5500000 AS reference_start,
  CAST((doc_id * 7) % 61 AS INT) AS mapping_quality,
  CASE WHEN LENGTH(s) < 100 THEN CONCAT(LENGTH(s), 'M')
       ELSE CONCAT('5S', LENGTH(s) - 57 - dlen, 'M2I', 20 + dlen, 'M', 1 + doc_id % 5, 'D', 30, 'M')
  END AS cigar,
  CASE WHEN LENGTH(s) < 10 THEN NULL ELSE s END AS query_sequence,
  CAST(CASE WHEN LENGTH(s) < 10 THEN 0 ELSE LENGTH(s) END AS INT) AS query_length,
  CONCAT('file', doc_id % 8) AS source_file,
  doc_id AS read_ordinal
FROM (SELECT doc_id, lang, doc_id % 7 AS dlen,
        {sequence} AS s
      FROM {documents}) x
"""

# The genome grows with the tables, so that the depth stays: 5.5 million bases for every 1,000 reads and 15,000 peaks.
_PLACE = "((o_orderkey * 104729) % 5500000 + CAST(FLOOR(o_orderkey / 15000) AS BIGINT) * 5500000)"

_PEAKS = """
SELECT o_orderkey AS peak_id, CONCAT('chr', 1 + o_orderkey % 3) AS chrom,
  {place} AS start, {place} + 40 + o_orderkey % 300 AS "end",
  CONCAT('peak', o_orderkey) AS name,
  CAST(o_orderkey % 1000 AS INT) AS score,
  '.' AS strand,
  CAST(o_orderkey % 97 AS DOUBLE) / 4 AS signalValue,
  CAST(o_orderkey % 89 AS DOUBLE) / 8 AS pValue,
  CAST(o_orderkey % 83 AS DOUBLE) / 16 AS qValue,
  CAST(o_orderkey % 40 AS INT) AS peak
FROM {orders}
""".replace("{place}", _PLACE)

_SCORES = """
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS label, score,
  score * 4 - 2 AS logit, CAST(CASE WHEN score > 0.5e0 THEN 1 ELSE 0 END AS INT) AS prediction
FROM (SELECT doc_id,
    (doc_id * 37 % 101) / 101.0e0 + CASE WHEN doc_id % 3 = 0 THEN 0.2e0 ELSE 0e0 END AS score
  FROM {documents}) x
"""


def _table(spark: SparkSession, sf_dir: str, name: str, query: str) -> DataFrame:
    source = spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return spark.sql(query.replace('"', "`").replace("{" + name + "}", "{src}"), src=source)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = f"{{documents}} LATERAL VIEW explode(array({_SEQUENCE.format(strip=_STRIP_SPARK)})) made AS sequence"
    return _table(spark, sf_dir, "documents", _READS.format(sequence="sequence", documents=once))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", _PEAKS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", _SCORES)


ORACLE_READS = _READS.format(sequence=_SEQUENCE.format(strip=_STRIP_ORACLE), documents="documents")
ORACLE_PEAKS = _PEAKS.format(orders="orders")
ORACLE_SCORES = _SCORES.format(documents="documents")
