"""From labelled windows to train, validation and test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.functions.sequences import prefix
from readwindows.operators import ranking
from readwindows.operators.windows import WINDOW_KEY
from readwindows.session import stage

SPLITS = ("train", "val", "test")
#: Repeated fingerprints that may be sent to all tasks (8 bytes each); of more, a bit each is sent.
BROADCAST_PRINTS = 4_000_000
#: Words of 64 bits that hold these bits.
PRINT_WORDS = 1 << 21


def label(df: DataFrame, value: int) -> DataFrame:
    return df.withColumn("labels", F.lit(value))


def combine(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """The union of both classes, columns matched by name."""
    return positives.unionByName(negatives)


def dedup(
    df: DataFrame,
    by: Sequence[str] = ("labels", "query_subseq"),
    order: Sequence[str] = tuple(WINDOW_KEY),
) -> DataFrame:
    """Keep the first row, by ``order``, of all rows equal in ``by``.

    Rows whose 64-bit fingerprint of ``by`` occurs once are kept as they are, without a shuffle: the
    fingerprints alone are counted, by a hash aggregate on fixed-width rows. The others are compared in full by an
    aggregate, so copies collapse before the shuffle: a sequence that fills a third of
    the table costs one row per task, where a window would gather all copies in one.
    Counting is an action; ``df`` is read three times.
    Of very many repeated fingerprints only bits are sent to the tasks, so some rows whose fingerprint occurs once are
    compared as well; no row is shuffled but those that are compared.
    """
    marked = df.withColumn("_print", F.xxhash64(*by))
    again = stage(marked.groupBy("_print").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_print"), "repeated")
    if again.count() <= BROADCAST_PRINTS:
        repeated, alone = (marked.join(F.broadcast(again), "_print", how) for how in ("left_semi", "left_anti"))
    else:
        word = F.col("_print").bitwiseAND(F.lit(PRINT_WORDS - 1))
        bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(_print, 58) as int))")
        masks = again.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_mask"))
        marked = marked.join(F.broadcast(masks), word == F.col("_word"), "left")
        hit = F.coalesce(F.col("_mask").bitwiseAND(bit) != 0, F.lit(False))
        repeated, alone = marked.where(hit), marked.where(~hit)
    rest = [c for c in df.columns if c not in by and c not in order]
    kept = [c for c in order if c not in by]
    first = repeated.groupBy(*by).agg(F.min(F.struct(*kept, *rest)).alias("first"))
    first = first.select(*[c if c in by else f"first.{c}" for c in df.columns])
    return alone.select(*df.columns).unionByName(first)


def downsample_per_group(
    df: DataFrame,
    group: str = "source_file",
    seed: int = 42,
    keys: Sequence[str] = tuple(WINDOW_KEY),
    counted: DataFrame | None = None,
) -> DataFrame:
    """Per file, keep as many random negatives as the file has positives.

    ``counted``: the same rows for the counting pass, if they are cheaper without payload.
    """
    return ranking.match_negatives(df, keys, seed, groups=[group], counted=counted)


def balance(
    df: DataFrame, seed: int = 42, strict: bool = True, keys: Sequence[str] = tuple(WINDOW_KEY)
) -> DataFrame:
    """Sample exactly as many negatives as there are positives.

    Raises when negatives are too few; ``strict=False`` keeps them all instead.
    """
    return ranking.match_negatives(df, keys, seed, strict=strict)


def shuffle(df: DataFrame, seed: int = 42, keys: Sequence[str] = tuple(WINDOW_KEY)) -> DataFrame:
    """Add ``shuffle_rank``, the 1-based place of each row in a seeded random order."""
    return ranking.hash_rank(df, keys, seed)


def truncate(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("query_subseq", prefix(F.col("query_subseq"), n))


def split(
    df: DataFrame,
    val: float = 0.2,
    test: float = 0.2,
    stratify: str = "labels",
    seed: int = 42,
    keys: Sequence[str] = tuple(WINDOW_KEY),
) -> DataFrame:
    """Add ``split``: per class, ``val`` of the rows, then ``test`` of the rest, then train."""
    n_val = F.ceil(F.lit(val) * F.col("_total"))
    n_test = F.ceil(F.lit(test) * (F.col("_total") - n_val))
    return ranking.cut_at(df, keys, seed, [stratify], "split", {"val": n_val, "test": n_val + n_test}, "train")


def part(df: DataFrame, name: str) -> DataFrame:
    """The feature and label columns of one split."""
    return df.where(F.col("split") == name).select("query_subseq", "labels")


def label_values(df: DataFrame) -> DataFrame:
    return df.select("labels").distinct()


def batches(
    df: DataFrame,
    size: int,
    keys: Sequence[str] = tuple(WINDOW_KEY),
    seed: int | None = None,
    epoch: int = 0,
) -> DataFrame:
    """Add ``batch``: in the order of ``keys``, or reshuffled per epoch when seeded."""
    if seed is None:
        place = ranking.ordered_positions(df, keys, "_place")
    else:
        ranked = ranking.hash_rank(df, keys, f"{seed}-{epoch}", name="_rank")
        place = ranked.withColumn("_place", F.col("_rank") - 1)
    return place.select(*df.columns, F.floor(F.col("_place") / size).alias("batch"))


def leakage(df: DataFrame, sequence: str = "query_subseq") -> DataFrame:
    """Distinct sequences shared by two splits: one row, three counts.

    One aggregate of flags per sequence, combined before the shuffle.
    """
    flags = [F.max(F.col("split") == s).alias(s) for s in SPLITS]
    shared = df.groupBy(sequence).agg(*flags)
    return shared.agg(
        F.count_if(F.col("train") & F.col("test")).alias("train_test"),
        F.count_if(F.col("train") & F.col("val")).alias("train_val"),
        F.count_if(F.col("test") & F.col("val")).alias("test_val"),
    )


def tag_splits(train: DataFrame, test: DataFrame, val: DataFrame) -> DataFrame:
    """Three split tables as one with a ``split`` column."""
    tables = {"train": train, "test": test, "val": val}
    tagged = [t.select("query_subseq", "labels", F.lit(s).alias("split")) for s, t in tables.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def assert_no_leakage(df: DataFrame) -> tuple[int, int, int]:
    """The three counts (an action); raises when train shares a sequence with test or val."""
    found = leakage(df).first()
    if found.train_test or found.train_val:
        raise ValueError(
            f"training sequences leak: {found.train_test} into test, {found.train_val} into validation"
        )
    return found.train_test, found.train_val, found.test_val
