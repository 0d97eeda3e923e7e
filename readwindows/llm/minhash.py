"""Near duplicates by an inverted join on MinHash coordinates.

Texts with equal shingle sets are one node. A node posts itself under each of its
``COORDINATES`` (coordinate, value) pairs. Two sets of similarity 0.8 agree in at least
``MATCHES`` of 64 coordinates, and in ``ALL_MATCHES`` of 256, but for some pairs in a
million. So

* a node with fewer than ``MATCHES`` pairs that occur elsewhere has no partner;
* of the others, any two partners meet under one of the rarest pairs of each, the prefix:
  as many pairs as may differ, and one more.

Nodes under one pair are first compared with the smallest of them (a star, not all pairs).
Links are confirmed on the full sets and joined to components. Then only pairs of nodes that
still lie in different components are compared, signature against signature in blocks, the
best few first and after that all the rest; none is given up. Where a block has many such pairs left, its full sets are
sent there instead, and all that leaves it is as few links as join its components. A group of copies thus costs
about one comparison per copy, however many links it has, and a group just below the threshold leaves no
pairs behind, though its task compares them.

Defined cases: a text with fewer words than a shingle has one shingle, the whole sequence;
null and empty texts, and texts without words, have no shingles and no partner. Rows of
equal id are one document: they share a component. A row with a null id has no component
and is kept. Extra columns are ignored, or passed on by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readwindows.llm import text as T
from readwindows.llm.components import components
from readwindows.llm.frames import free_name
from readwindows.session import broadcast_up_to, stage

WORDS, PERCENT = 5, 80
COORDINATES, MATCHES = 64, 36
#: One byte of each of these more coordinates only serves to compare two signatures.
MORE, ALL_MATCHES = 192, 172
BEST, BLOCK = 4, 1024
#: Pairs per row of a block beyond which its pairs are confirmed where they meet.
PAIRS_A_ROW = 1
#: Rows of ids or of pairs that may be sent to all tasks (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Fixed random odd multipliers of the coordinates.
_MULTIPLIERS = np.random.default_rng(10).integers(1, 1 << 63, COORDINATES + MORE, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_SKETCH = "doc_id long, n long, set_a long, set_b long, signature binary"
_SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of every row, ascending within it, and the n + 1 offsets."""
    hashes, at = T.word_hashes(column, T.NON_SPACE)
    counts = np.diff(at)
    per_row = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    length = np.repeat(np.minimum(counts, words), per_row)
    first = T.ranges(at[:-1], per_row)
    value = length.astype(np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    for k in range(words):
        inside = k < length
        value = np.where(inside, T.mix(value * _STEP + padded[first + k]), value)
    row = np.repeat(np.arange(len(counts)), per_row)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def _reduce(function: np.ufunc, values: np.ndarray, at: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(at) - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = function.reduceat(values, at[some])
    return out


def _signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row 4 bytes of each of the first coordinates, then one of each other."""
    out = np.empty((len(at) - 1, 4 * COORDINATES + MORE), dtype=np.uint8)
    for k, multiplier in enumerate(_MULTIPLIERS):
        least = _reduce(np.minimum, ((values * multiplier) >> np.uint64(32)).astype(np.uint32), at, 0)
        if k < COORDINATES:
            out[:, 4 * k : 4 * k + 4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
        else:
            out[:, 3 * COORDINATES + k] = least.astype(np.uint8)
    return out


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """Per row: set size, a 128-bit name of the set, and its signature."""

    def run(batches):
        for batch in batches:
            texts = T.binary(batch.column(1))
            for lo, hi in T.pieces(texts):
                values, at = shingles(texts[lo:hi], words)
                names = [_reduce(np.add, T.mix(values ^ np.uint64(salt)), at, 0).view(np.int64) for salt in (0, 0x5851F42D4C957F2D)]
                raw = pa.py_buffer(_signatures(values, at).tobytes())
                signature = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COORDINATES + MORE), hi - lo, [None, raw]).cast(pa.binary())
                columns = [batch.column(0)[lo:hi], pa.array(np.diff(at)), *map(pa.array, names), signature]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _SKETCH_ARROW, strict=True)], schema=_SKETCH_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SKETCH)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The signatures' first coordinates, and the bytes of the others."""
    data, _ = T.flat(column.cast(pa.large_binary()))
    rows = data.reshape(-1, 4 * COORDINATES + MORE)
    return np.ascontiguousarray(rows[:, : 4 * COORDINATES]).view("<u4"), rows[:, 4 * COORDINATES :]


def _alike(s: tuple[np.ndarray, np.ndarray], t: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Coordinates in which the rows agree, or 0 where these are too few for a link."""
    first, more = (s[0] == t[0]).sum(axis=1), (s[1] == t[1]).sum(axis=1)
    return np.where((first >= MATCHES) & (first + more >= ALL_MATCHES), first + more, 0)


def _tokens(nodes: DataFrame) -> DataFrame:
    """(node, token) for every coordinate; the token holds coordinate and value."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                values = _matrix(part.column(1))[0].astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.repeat(part.column(0).to_numpy(), COORDINATES)), "token": pa.array(values.ravel())})

    return nodes.select("node", "signature").mapInArrow(run, "node long, token long")


def _postings(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node, prefix, n): the rarest shared pairs of the nodes that may have a partner.

    ``prefix`` has a bit for each coordinate whose pair is among these. Nodes that have too few shared pairs leave
    first; of the others' pairs those leave that no node of a similar size has, and again the nodes with too few.
    """
    tokens = _tokens(nodes)
    shared = tokens.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    held = tokens.join(shared, "token").groupBy("node").agg(F.collect_list(F.struct("holders", "token")).alias("held"))
    able = stage(held.where(F.size("held") >= MATCHES).join(nodes.select("node", "n"), "node"), "able")
    # Sizes that are similar enough lie in one class or in two neighbouring ones.
    width = log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    size = F.floor(F.ln("n") / F.lit(width))
    each = able.select("node", F.explode("held").alias("pair"), size.alias("size")).select("node", "pair.holders", "pair.token", "size")
    # So a pair is useful to a node if another node that has it is in the same class or in one beside it.
    sizes = each.groupBy("token", "size").agg(F.count("*").alias("m")).groupBy("token").agg(F.collect_list(F.struct("size", "m")).alias("sizes"))
    near = F.expr("aggregate(sizes, 0L, (m, s) -> m + if(abs(s.size - size) <= 1, s.m, 0L)) > 1")
    held = F.collect_set(F.struct("holders", "token")).alias("held")
    useful = each.join(sizes, "token").where(near).groupBy("node").agg(held).where(F.size("held") >= MATCHES)
    # The order by all holders is the same for every node, so partners find their first common pair in both prefixes.
    rare = useful.select("node", F.expr(f"slice(array_sort(held), 1, size(held) - {MATCHES} + 1).token").alias("rare"))
    bits = F.expr("aggregate(rare, 0L, (bits, token) -> bits | shiftleft(1L, cast(shiftright(token, 32) as int)))")
    return rare.select(F.explode("rare").alias("token"), "node", bits.alias("prefix")).join(able.select("node", "n"), "node")


def _near(a: str, b: str, percent: int) -> str:
    return f"least({a}, {b}) * 100 >= greatest({a}, {b}) * {percent}"


def _star_pairs(postings: DataFrame, percent: int) -> DataFrame:
    hubs = postings.groupBy("token").agg(F.min(F.struct("node", "n")).alias("hub"))
    met = postings.join(hubs, "token").where(f"node <> hub.node and {_near('n', 'hub.n', percent)}")
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in enough coordinates."""
    sides = nodes.select("node", "signature")
    first = sides.toDF("a", "s").join(_small(stage(pairs.select("a").distinct(), "hubs")), "a", "left_semi")
    both = _small(pairs).join(sides.toDF("b", "t"), "b").join(first, "a")

    def run(batches):
        for batch in batches:
            same = _alike(_matrix(batch.column("s")), _matrix(batch.column("t"))) > 0
            yield batch.select(["a", "b"]).filter(pa.array(same))

    return both.mapInArrow(run, "a long, b long").distinct()


def _small(rows: DataFrame) -> DataFrame:
    """A staged table of one or two ids a row, sent to all tasks if it is known to be small."""
    return broadcast_up_to(rows, rows.count(), BROADCAST_ROWS)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, shingles): six bytes of every fingerprint, ascending."""

    def run(batches):
        for batch in batches:
            texts = T.binary(batch.column(1))
            for lo, hi in T.pieces(texts):
                values, at = shingles(texts[lo:hi], words)
                packed = (values >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                sets = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((at * 6).astype(np.int64)), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], sets.cast(pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return texts.join(_small(ids), "node", "left_semi").mapInArrow(run, "node long, shingles binary")


def _unpack(value: bytes) -> np.ndarray:
    out = np.zeros((len(value) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(value, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def run(batches):
        hub, mine = None, None
        for batch in batches:
            keep = []
            for a, s, t in zip(batch.column("a").to_pylist(), batch.column("s"), batch.column("t"), strict=True):
                if a != hub or hub is None or s.as_py() != raw:
                    hub, raw = a, s.as_py()
                    mine = _unpack(raw)
                other = _unpack(t.as_py())
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    members = _small(pairs).join(sets.toDF("b", "t"), "b")
    first = sets.toDF("a", "s").join(_small(stage(pairs.select("a").distinct(), "hubs")), "a", "left_semi")
    return members.join(first, "a").select("a", "b", "s", "t").mapInArrow(run, "a long, b long").distinct()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal first three columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1 if len(key) else []
        if held and len(key):
            last = held[-1]
            if tuple(last.column(k)[-1].as_py() for k in range(3)) != tuple(key[0].tolist()):
                yield pa.Table.from_batches(held)
                held = []
        lo = 0
        for edge in edges:
            yield pa.Table.from_batches([*held, batch.slice(lo, edge - lo)])
            held, lo = [], edge
        if len(key):
            held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(postings: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (token, i, j, mine, node, c, n, prefix) of the tokens whose nodes lie in different components.

    Block (i, j) of a token holds the rows of its parts i and j, so that any two rows meet in one task.
    """
    now = postings.join(parts.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    mixed = now.groupBy("token").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    rows = now.join(mixed.select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "token")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "c", "n", "prefix")


def _by_block(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")


class _Block:
    """The rows of a block, and which of them agree."""

    def __init__(self, group: pa.Table, percent: int) -> None:
        token, self.i, self.j = (group.column(k)[0].as_py() for k in ("token", "i", "j"))
        self.mine, self.node, self.c, self.n, self.prefix = (group.column(k).to_numpy() for k in ("mine", "node", "c", "n", "prefix"))
        self.sign, self.percent = _matrix(group.column("signature").combine_chunks()), percent
        self.here = np.int64(1) << np.int64(token >> 32)
        self.left, self.right = np.flatnonzero(self.mine == self.i), np.flatnonzero(self.mine == self.j)

    def partners(self, x: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of another label that agree with row ``x``, and in how many coordinates."""
        n, sign = self.n, self.sign
        y = self.right[(self.right > x) if self.i == self.j else slice(None)]
        y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * self.percent)]
        if not len(y):
            return y, y
        same = _alike((sign[0][y], sign[1][y]), (sign[0][x], sign[1][x]))
        y, same = y[same > 0], same[same > 0]
        # A pair that meets under several tokens counts under the first.
        bits = ((sign[0][y] == sign[0][x]) << np.arange(COORDINATES)).sum(axis=1) & self.prefix[y] & self.prefix[x]
        first = (bits & -bits) == self.here
        return y[first], same[first]


def _apart(postings: DataFrame, nodes: DataFrame, parts: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Agreeing pairs (a, b) of nodes that meet under a token but lie in different components.

    Of each node's partners under a token only the ``best`` ones, if that is given. Otherwise a block with more
    pairs than ``PAIRS_A_ROW`` for every row of it gives only its name (token, i, j); a and b are null there.
    """
    rows = _blocks(postings, parts).join(nodes.select("node", "signature"), "node")
    rows = rows.select("token", "i", "j", "mine", "node", "c", "n", "prefix", "signature")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])

    def run(batches):
        for group in _by_key(batches):
            block = _Block(group, percent)
            out_a, out_b, found, most = [], [], 0, PAIRS_A_ROW * len(group)
            for x in block.left:
                y, same = block.partners(x, block.c)
                if best is not None and len(y) > best:
                    y = y[np.lexsort((block.node[y], -same))[:best]]
                out_a.append(np.full(len(y), block.node[x]))
                out_b.append(block.node[y])
                found += len(y)
                if best is None and found > most:
                    break
            if best is None and found > most:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2 + [group.column(k).combine_chunks()[:1].cast(out.field(k).type) for k in ("token", "i", "j")], schema=out)
            elif found:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(found, f.type) for f in list(out)[2:])], schema=out)

    return _by_block(rows).mapInArrow(run, "a long, b long, token long, i int, j int")


def _forest(names: DataFrame, postings: DataFrame, nodes: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components within each named block, as few as do.

    The agreeing pairs of a block are confirmed on full sets where they meet, so none of them leaves the task.
    """
    rows = _blocks(postings, parts).join(_small(names), ["token", "i", "j"], "left_semi")
    rows = rows.join(nodes.select("node", "signature"), "node").join(sets, "node")
    rows = rows.select("token", "i", "j", "mine", "node", "c", "n", "prefix", "signature", "shingles")

    def run(batches):
        for group in _by_key(batches):
            block = _Block(group, percent)
            held = group.column("shingles")
            label, out_a, out_b = block.c.copy(), [], []
            for x in block.left:
                y, _ = block.partners(x, label)
                if not len(y):
                    continue
                mine = _unpack(held[int(x)].as_py())
                others = [_unpack(held[int(k)].as_py()) for k in y]
                flat = np.concatenate(others)
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                common = np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
                sizes = np.array([len(o) for o in others])
                for k in y[100 * common >= percent * (len(mine) + sizes - common)]:
                    if label[k] != label[x]:
                        out_a.append(min(block.node[x], block.node[k]))
                        out_b.append(max(block.node[x], block.node[k]))
                        label[label == label[k]] = label[x]
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return _by_block(rows).mapInArrow(run, "a long, b long").distinct()


def membership(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (it is the smallest of its component)."""
    rows = stage(_sketches(docs, words), "sketches")
    name = ["set_a", "set_b", "n"]
    sets = rows.where("n > 0 and doc_id is not null").groupBy(*name).agg(F.min(F.struct("doc_id", "signature")).alias("first"))
    nodes = stage(sets.select(*name, F.col("first.doc_id").alias("node"), F.col("first.signature").alias("signature")), "nodes")
    # Two different sets can only be similar enough if one more shingle is a small enough change.
    least = percent / (100 - percent) if percent < 100 else float("inf")
    postings = stage(_postings(nodes.where(F.col("n") >= least), percent), "postings")
    able = stage(postings.select("node").distinct(), "able")
    signed = stage(nodes.join(_small(able), "node", "left_semi"), "signatures")
    full = stage(_sets(docs, able, words), "sets")
    tested = stage(_agreeing(stage(_star_pairs(postings, percent), "stars"), signed), "pairs")
    links = stage(_confirmed(tested, full, percent), "links")
    parts = stage(components(links), "components")
    for best in (BEST, None):
        apart = stage(_apart(postings, signed, parts, percent, best), "apart")
        pairs = stage(apart.where("b is not null").select("a", "b").distinct().join(_small(tested), ["a", "b"], "left_anti"), "pairs")
        found = _confirmed(pairs, full, percent)
        names = apart.where("b is null").select("token", "i", "j")
        if best is None and names.limit(1).count():
            found = found.unionByName(_forest(names, postings, signed, full, parts, percent))
        found = stage(found, "links")
        if found.limit(1).count():
            links = links.unionByName(found)
            parts = stage(components(links), "components")
        tested = tested.unionByName(pairs)
    of_set = nodes.select(*name, "node").join(parts.toDF("node", "c"), "node", "left").select(*name, F.coalesce("c", "node").alias("c"))
    # One set may have several names for its first document only if ids repeat; the smallest counts.
    of_set = of_set.groupBy(*name).agg(F.min("c").alias("c"))
    out = rows.select("doc_id", *name).join(of_set, name, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns."""
    leave = membership(docs, words, percent).where("not kept").select("doc_id").distinct()
    return docs.join(leave, "doc_id", "left_anti").select(*docs.columns)
