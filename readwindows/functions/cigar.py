"""CIGAR strings as column expressions.

A read's alignment stays inside its own row: operations, gap-free blocks and windows
are arrays, so nothing here needs a shuffle, and no row per base is ever made.
Every step is linear in the number of operations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readwindows.functions.lets import let

# Which coordinates a CIGAR operation advances (SAM specification).
OPERATION = r"([0-9]+)([MIDNSHP=X])"
PAIRED = ("M", "=", "X")
ADVANCES_QUERY = ("M", "I", "S", "=", "X")
ADVANCES_REFERENCE = ("M", "D", "N", "=", "X")

START = "struct<p:bigint,q:bigint,r:bigint>"
BLOCK = "struct<p:bigint,n:bigint,q:bigint,r:bigint>"
# ``aggregate`` copies its state at every element, so no state may hold an array that
# grows with the read. Operations are therefore taken in runs of this many.
RUN = 32


def operations(cigar: Column) -> Column:
    """``array<struct<n, code>>``; empty for ``*`` or null."""
    texts = F.coalesce(
        F.regexp_extract_all(cigar, F.lit(OPERATION), F.lit(0)), F.array().cast("array<string>")
    )
    return F.transform(
        texts,
        lambda t: F.struct(
            F.substring(t, F.lit(1), F.length(t) - 1).cast("bigint").alias("n"),
            F.right(t, F.lit(1)).alias("code"),
        ),
    )


def _advance(op: Column, codes: tuple[str, ...]) -> Column:
    return F.when(op["code"].isin(*codes), op["n"]).otherwise(F.lit(0))


def _after(start: Column, op: Column) -> list[Column]:
    """Pair index, query and reference position after ``op``."""
    return [
        (start["p"] + _advance(op, PAIRED)).alias("p"),
        (start["q"] + _advance(op, ADVANCES_QUERY)).alias("q"),
        (start["r"] + _advance(op, ADVANCES_REFERENCE)).alias("r"),
    ]


def reference_length(cigar: Column) -> Column:
    """Reference bases covered by the alignment."""
    return F.aggregate(
        operations(cigar), F.lit(0).cast("bigint"), lambda s, op: s + _advance(op, ADVANCES_REFERENCE)
    )


def _start(p: Column, q: Column, r: Column) -> list[Column]:
    return [p.cast("bigint").alias("p"), q.cast("bigint").alias("q"), r.cast("bigint").alias("r")]


def _append(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def _run_starts(runs: Column, reference_start: Column) -> Column:
    """Where each run of operations begins: ``array<struct<p, q, r>>``."""
    zero = F.struct(*_start(F.lit(0), F.lit(0), F.lit(0)))
    lengths = F.transform(runs, lambda run: F.aggregate(run, zero, lambda s, op: F.struct(*_after(s, op))))
    first = F.struct(
        *_start(F.lit(0), F.lit(0), reference_start), F.array().cast(f"array<{START}>").alias("seen")
    )
    return F.aggregate(
        lengths,
        first,
        lambda s, d: F.struct(
            (s["p"] + d["p"]).alias("p"),
            (s["q"] + d["q"]).alias("q"),
            (s["r"] + d["r"]).alias("r"),
            _append(s["seen"], F.struct(s["p"].alias("p"), s["q"].alias("q"), s["r"].alias("r"))).alias("seen"),
        ),
        lambda s: s["seen"],
    )


def _run_blocks(run: Column, start: Column) -> Column:
    """The gap-free blocks of one run."""
    first = F.struct(
        *_start(start["p"], start["q"], start["r"]), F.array().cast(f"array<{BLOCK}>").alias("found")
    )

    def step(s: Column, op: Column) -> Column:
        block = F.struct(s["p"].alias("p"), op["n"].alias("n"), s["q"].alias("q"), s["r"].alias("r"))
        found = F.when(op["code"].isin(*PAIRED), _append(s["found"], block)).otherwise(s["found"])
        return F.struct(*_after(s, op), found.alias("found"))

    return F.aggregate(run, first, step, lambda s: s["found"])


def blocks(cigar: Column, reference_start: Column) -> Column:
    """Gap-free blocks ``array<struct<p, n, q, r>>``.

    A block of ``n`` aligned pairs starts at pair index ``p``, query position ``q`` and
    reference position ``r``.
    """

    def in_runs(ops: Column) -> Column:
        starts = F.when(F.size(ops) > 0, F.sequence(F.lit(1), F.size(ops), F.lit(RUN)))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")), lambda at: F.slice(ops, at, F.lit(RUN))
        )

    def placed(runs: Column) -> Column:
        return F.flatten(F.zip_with(runs, _run_starts(runs, reference_start), _run_blocks))

    return let(let(operations(cigar), in_runs), placed)


def _multiples(low: Column, high: Column, step: int, body) -> Column:
    """``body(i)`` for the multiples of ``step`` in ``[low, high]``; empty when there is none.

    ``sequence`` counts down when its bounds are reversed, hence the guard.
    """
    first = F.ceil(low / F.lit(step)).cast("bigint") * step
    return F.when(first <= high, F.transform(F.sequence(first, high, F.lit(step).cast("bigint")), body))


def windows(cigar: Column, reference_start: Column, size: int, step: int) -> Column:
    """Windows of ``size`` consecutive aligned pairs, every ``step`` pairs.

    ``array<struct<i, query_start, query_end, reference_start, reference_end>>``, ends
    exclusive. Only windows without a reference gap are kept; insertions may lie inside.

    Window starts and window ends are placed block by block. Both lists are complete and
    ordered by the pair index ``i`` = 0, step, 2*step ..., so they are matched by position.
    """

    def starts_in(b: Column) -> Column:
        return _multiples(
            b["p"],
            b["p"] + b["n"] - 1,
            step,
            lambda i: F.struct(i.alias("i"), (b["q"] + i - b["p"]).alias("q"), (b["r"] + i - b["p"]).alias("r")),
        )

    def ends_in(b: Column) -> Column:
        return _multiples(
            F.greatest(b["p"] - (size - 1), F.lit(0)),
            b["p"] + b["n"] - size,
            step,
            lambda i: F.struct(
                (b["q"] + i - b["p"] + size).alias("q"),
                (b["r"] + i - b["p"] + size).alias("r"),
            ),
        )

    def joined(bs: Column) -> Column:
        starts = F.flatten(F.filter(F.transform(bs, starts_in), F.isnotnull))
        ends = F.flatten(F.filter(F.transform(bs, ends_in), F.isnotnull))
        pairs = F.zip_with(
            starts,
            ends,
            lambda a, z: F.struct(
                a["i"].alias("i"),
                a["q"].alias("query_start"),
                z["q"].alias("query_end"),
                a["r"].alias("reference_start"),
                z["r"].alias("reference_end"),
            ),
        )
        return F.filter(pairs, lambda w: w["reference_end"] - w["reference_start"] == size)

    return let(blocks(cigar, reference_start), joined)
