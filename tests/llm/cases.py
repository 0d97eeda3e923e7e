"""Documents with everything that may be odd about a row."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo", "wu") for c in ("n", "m", "s", "lt", "rk")]


def prose(seed: int, n: int) -> str:
    """``n`` words that depend on the seed alone."""
    state, out = seed * 7919 + 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)])
    return " ".join(out)


def odd_rows() -> list[tuple]:
    long = prose(1, 30_000)
    return [
        (1, prose(2, 60), "en", "a", 1),
        (2, prose(2, 60), "en", "a", 1),
        (3, prose(2, 59) + " other", None, None, None),
        (3, prose(2, 59) + " other", None, None, None),
        (4, None, "en", "b", None),
        (5, "", "en", "b", 0),
        (6, " \t\n ... ", "en", "c", 7),
        (None, prose(3, 40), "en", "c", 5),
        (None, None, None, None, None),
        (7, long, "en", "a", len(long)),
        (8, long + " end", "en", "b", len(long)),
        (9, "word", "en", "c", 4),
        (10, "Éà ÜBER ñandú Ünï " + prose(4, 30), "fr", "b", 9),
        (11, "x" * 5000, "en", "a", 5000),
    ]


def odd_docs(spark: SparkSession):
    """The odd rows with extra columns that clash with names used inside the operators."""
    docs = spark.createDataFrame(odd_rows(), DOCS)
    extra = ("score", "_score", "hits", "_hits", "items", "_items", "shard", "name", "node", "a", "b", "size", "key", "bucket", "first", "token", "of")
    return docs.select("*", *[F.lit("x").alias(c) for c in extra])


def no_docs(spark: SparkSession):
    return spark.createDataFrame([], DOCS)


def labels(spark: SparkSession, rows=((1, 1, 0), (2, None, None), (3, 0, 0), (None, 1, 1), (7, 1, 0), (7, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
