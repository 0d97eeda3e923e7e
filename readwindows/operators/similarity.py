"""Alignment similarity of pairs: all near ones, or those of a stated number of first rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readwindows.functions.similarity import WORDS, Signed, common_letters, four_signature, like_pairs, similarity
from readwindows.operators.ranking import first_rows
from readwindows.session import broadcast_up_to, stage

BROADCAST_SEQUENCES = 1_000
#: Letters of the longer sequence that near pairs may have outside the common subsequence: similarity 0.96 at 50 letters.
EDITS = 2
#: Pieces of the shorter sequences that a bucket has, about, and sequences with one piece from which it counts as common.
BUCKET_PIECES, COMMON = 100_000, 4_096


def near_pairs(df: DataFrame, sequence: str = "query_subseq", edits: int = EDITS) -> DataFrame:
    """``(a, b, score)`` of all pairs ``a < b`` of different sequences at most ``edits`` apart; none is missed.

    Two sequences are ``edits`` apart if the longer one has that many letters outside the
    longest common subsequence, so the score is 1 - edits / longer length or more. Then each has at most ``edits`` letters
    outside it. Cut the shorter one into 2 * ``edits`` + 1 pieces: some piece ``p`` stands whole in the longer one with at most ``p``
    such letters before it and 2 * ``edits`` - ``p`` behind it (the first piece up to which there are no more letters than its number),
    which bounds how far it is moved. Only lengths that occur are asked for. The distinct sequences are written once (an
    action), with a number and a signature of their runs of four letters. A piece travels with
    these alone; pairs whose signatures differ in more bits than their letters can change go no further where they
    meet. Only the others are made distinct, meet their sequences, and are scored.
    Sequences shorter than the number of pieces have empty pieces, which all others of nearly their length share.
    Pieces that very many sequences have are dealt out in parts.
    """
    parts = 2 * edits + 1
    distinct = df.select(F.col(sequence).alias("_s")).where("_s is not null").distinct()
    texts = stage(distinct.select(F.monotonically_increasing_id().alias("_id"), "_s", F.length("_s").alias("_length"), four_signature("_s").alias("_runs")), "distinct")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def keyed(rows: DataFrame) -> DataFrame:
        bounds = rows.select("*", F.expr(f"_part * _size div {parts}").cast("int").alias("_from"), F.expr(f"(_part + 1) * _size div {parts}").cast("int").alias("_to"))
        inside = bounds.where("_from + _move >= 0 and _to + _move <= _length")
        piece = F.substr("_s", F.col("_from") + F.col("_move") + 1, F.col("_to") - F.col("_from"))
        # Equal keys of different pieces only propose a pair more.
        return inside.select(F.xxhash64("_size", "_part", piece).alias("key"), F.col("_id").alias("id"), (F.col("_length") - F.col("_size")).cast("byte").alias("more"), "_runs.*")

    shorter = keyed(texts.select("*", F.col("_length").alias("_size"), F.lit(0).alias("_move"), numbers.alias("_part")))
    sizes = F.explode(F.sequence(F.greatest(F.col("_length") - edits, F.lit(0)), F.col("_length")))
    occurring = texts.select(F.col("_length").alias("_size")).distinct()
    runs = texts.select("*", sizes.alias("_size")).join(F.broadcast(occurring), "_size", "left_semi").select("*", numbers.alias("_part"))
    more, behind = F.col("_length") - F.col("_size"), F.lit(parts - 1) - F.col("_part")
    first = F.greatest(-F.col("_part"), more - behind, more - edits)
    last = F.least(F.col("_part"), more + behind, F.lit(edits))
    runs = runs.select("*", first.alias("_first"), last.alias("_last")).where("_first <= _last")
    longer = keyed(runs.select("*", F.explode(F.sequence("_first", "_last")).alias("_move")))
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(texts.count() * parts / BUCKET_PIECES))
    shorter, longer = _dealt(shorter, longer, buckets)

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        sides = (Signed(*(side.column(c).to_numpy() for c in ("key", "id", "more")), [side.column(w).to_numpy().view(np.uint64) for w in WORDS]) for side in (x, y))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in like_pairs(*sides, edits):
            found.append(np.unique(np.sort(np.column_stack((a, b)), axis=1), axis=0))
        i, j = np.unique(np.concatenate(found), axis=0).T
        return pa.table({"i": pa.array(i), "j": pa.array(j)})

    met = shorter.groupBy("bucket").cogroup(longer.groupBy("bucket")).applyInArrow(meet, "i long, j long").distinct()
    known = texts.select("_id", "_s")
    met = met.join(known.toDF("i", "_x"), "i").join(known.toDF("j", "_y"), "j")
    longest = F.greatest(F.length("_x"), F.length("_y"))
    scored = met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), common_letters(F.col("_x"), F.col("_y"), longest - edits).alias("_common"))
    near = scored.where("_common >= 0").distinct()
    return near.select("a", "b", (F.col("_common") / F.nullif(F.greatest(F.length("a"), F.length("b")), F.lit(0))).alias("score"))


def _dealt(shorter: DataFrame, longer: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the ``bucket`` where equal keys meet; a key that more than ``COMMON`` of the shorter ones have is
    dealt out in parts of both sides, and each part of one meets each of the other."""
    counted = shorter.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COMMON)
    common = F.broadcast(stage(counted.select("key", F.ceil(F.sqrt(F.col("n") / COMMON)).cast("int").alias("of")), "common"))
    whole, mine = F.coalesce("of", F.lit(1)), F.pmod(F.xxhash64("id"), F.coalesce("of", F.lit(1)))

    def side(rows: DataFrame, grid: Column) -> DataFrame:
        # One row for each part of the other side.
        each = rows.join(common, "key", "left").select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("other"))
        return each.select(F.pmod(F.xxhash64("key", grid), F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64("key", grid).alias("key"), "id", "more", *WORDS)

    return side(shorter, F.col("mine") * whole + F.col("other")), side(longer, F.col("other") * whole + F.col("mine"))


def pairwise(
    df: DataFrame, order: Sequence[str], sequence: str = "query_subseq", *, limit: int
) -> DataFrame:
    """``(i, j, score)`` for all ordered pairs of the first ``limit`` rows, 0-based.

    The limit is part of the operator: its result is a square matrix. The score is
    symmetric, so each pair is scored once and written both ways. Pairs of numbers are
    made first and meet their sequences by equi-joins.
    """
    spark = df.sparkSession
    first = first_rows(df.select(*order, sequence), order, limit)
    numbered = first.select(
        (F.row_number().over(Window.orderBy(*order)) - 1).alias("_id"), F.col(sequence).alias("_seq")
    )
    numbered = broadcast_up_to(numbered, limit, BROADCAST_SEQUENCES)
    ids = spark.range(limit).select(F.col("id").cast("int").alias("i"))
    pairs = ids.select("i", F.explode(F.sequence("i", F.lit(limit - 1))).alias("j")).repartition("i", "j")
    scored = (
        pairs.join(numbered.toDF("i", "_a"), "i")
        .join(numbered.toDF("j", "_b"), "j")
        .select("i", "j", similarity(F.col("_a"), F.col("_b")).alias("score"))
    )
    mirrored = F.array(F.struct("i", "j", "score"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    once = F.array(F.struct("i", "j", "score"))
    return scored.select(F.inline(F.when(F.col("i") == F.col("j"), once).otherwise(mirrored)))
