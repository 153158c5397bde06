"""Merkle manifest of a dataset, with proofs folded from midstates.

Every row is a leaf: the SHA-256 of its fields.  Leaves of one source, in the
order of their ids, are joined three by three, level by level, to a subroot,
and the subroots of all sources likewise to the root.  A parent keeps the
hash state before each of its child slots.  To fold a changed leaf, the state
before its slot is resumed with the new digest and the siblings to the right;
what stands to the left is never hashed again.

On Spark: leaves are sorted by ranges of (source, id), and a row's place
among its source's leaves is its place in its partition plus the rows of that
source in earlier ones, so no source meets in one task.  A tier then takes
blocks of ``BLOCK_LEAVES`` consecutive nodes and reduces each to one node, as
many levels at once as that is; two or three tiers suffice for any table.
Going down, a block gets one head row, its path to the root: for each level
the state before its slot and its siblings (``STEP``), from which all its
members go on.  A source with a third of all rows is so many blocks more.

Defined results: nulls are hashed as ``-``; a null source is a source of its
own and comes first; rows with a null id come first in their source; rows
with equal ids are ordered by their leaves, and equal rows by any order,
which gives the same hashes; one row is its own subroot and root, and its
proof the hash of nothing; texts are hashed whole, by Spark; columns beside
the hashed fields are not read, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import sha_states as sha
from tidemark.llm.common import stored

ARITY = 3                   # FIXED VALUE of the digest contract
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 8                  # of a tier
BLOCK_LEAVES = ARITY ** LEVELS
HELD = 1 << 15              # rows a task gathers before it works on them
# one level of a path: the state before the slot, its siblings left and right of it
STEP = np.dtype([("state", ">u4", 8), ("left", "u1"), ("right", "u1"), ("sibling", "u1", (ARITY - 1, sha.BLOCK))])


# ---- leaves and places ---------------------------------------------------------

def leaf_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 over ``-`` for a null, else byte count, ``:`` and value."""
    parts = []
    for c in columns.values():
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def in_ranges(rows: DataFrame, group: Column, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted by ranges of (group, order), each with ``at``, which
    ascends inside its range, and the ranges' ``spans``: first place and rows
    of each group in each range."""
    by = [group.asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    spans = ranged.groupBy("part", group.alias("g")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    return ranged, stored(spans, f"{name}-spans")              # rows: ranges + groups


def placed(ranged: DataFrame, spans: DataFrame, group: Column) -> DataFrame:
    """``ranged`` with ``place``, a row's position in its group, ``total``,
    the rows of that group, and further columns of ``spans``.  Joined range
    by range, so that no group meets in one task."""
    earlier = Window.partitionBy("g").orderBy("part")
    spans = spans.select(F.col("part").alias("__part"), F.col("g").alias("__g"),
                         *[c for c in spans.columns if c not in ("part", "g", "first", "rows")],
                         (F.sum("rows").over(earlier) - F.col("rows") - F.col("first")).alias("shift"),
                         F.sum("rows").over(Window.partitionBy("g")).alias("total"))
    joined = ranged.join(spans, (F.col("part") == F.col("__part")) & group.eqNullSafe(F.col("__g")))
    return joined.withColumn("place", F.col("at") + F.col("shift"))


# ---- one block -------------------------------------------------------------------

def depth(total: np.ndarray) -> np.ndarray:
    """Levels until one node is left of so many."""
    out, left = np.zeros(len(total), np.int64), total.astype(np.int64)
    while (left > 1).any():
        out[left > 1] += 1
        left = -(-left // ARITY)
    return out


class Level:
    """Parents over the nodes of one level, with the states before their slots."""

    def __init__(self, digest: np.ndarray, block: np.ndarray, place: np.ndarray, live: np.ndarray):
        """digest: n x 64 characters; nodes sorted by (block, place); nodes
        of blocks that are not live stay as they are."""
        self.digest, self.slot = digest, np.where(live, place % ARITY, 0)
        head = self.slot == 0
        self.parent = np.cumsum(head) - 1
        self.first = np.flatnonzero(head)
        self.count = np.bincount(self.parent, minlength=len(self.first))
        self.live = live[self.first]
        self.block, self.place = block[self.first], np.where(self.live, place[self.first] // ARITY, place[self.first])
        state = sha.begun(len(self.first))
        self.states = np.zeros((len(self.first), ARITY, 8), np.uint32)
        for s in range(ARITY):
            self.states[:, s] = state
            on = np.flatnonzero(self.live & (self.count > s))
            state[on] = sha.advanced(state[on], digest[self.first[on] + s])
        self.above = digest[self.first].copy()
        on = np.flatnonzero(self.live)
        self.above[on] = sha.hexed(sha.closed(state[on], self.count[on]))

    def steps(self, node: np.ndarray) -> np.ndarray:
        """One ``STEP`` for each node (of a live block)."""
        parent, slot = self.parent[node], self.slot[node]
        out = np.zeros(len(node), STEP)
        out["state"] = self.states[parent, slot]
        out["left"], out["right"] = slot, self.count[parent] - slot - 1
        for i in range(ARITY - 1):
            beside = self.first[parent] + i + (i >= slot)
            there = np.flatnonzero(i < self.count[parent] - 1)
            out["sibling"][there, i] = self.digest[beside[there]]
        return out


def levels_of(digest: np.ndarray, block: np.ndarray, place: np.ndarray, total: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels of all blocks at once, and the digest each block ends in.
    block: running number of each row's block; total: nodes of its tree."""
    height = np.minimum(depth(total), LEVELS)
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    height, levels = height[heads], []
    while len(levels) < height.max(initial=0):
        live = height[block] > len(levels)
        levels.append(Level(digest, block, place, live))
        digest, block, place = levels[-1].above, levels[-1].block, levels[-1].place
    return levels, digest


def up(level: Level, node: np.ndarray) -> np.ndarray:
    return level.parent[node]


def fold(digest: np.ndarray, proof: np.ndarray, length: np.ndarray, steps: np.ndarray, on: np.ndarray) -> None:
    """One level, in place, for rows ``on``: the state before the slot is
    resumed with the digest and the siblings to the right; the proof's own
    state takes all siblings, left to right.  steps: one for each of ``on``."""
    if not len(on):
        return
    left, right = steps["left"].astype(np.int64), steps["right"].astype(np.int64)
    state = sha.advanced(steps["state"].astype(np.uint32), digest[on])
    for i in range(ARITY - 1):
        there = np.flatnonzero(i < left + right)
        proof[on[there]] = sha.advanced(proof[on[there]], steps["sibling"][there, i])
        there = np.flatnonzero((i >= left) & (i < left + right))
        state[there] = sha.advanced(state[there], steps["sibling"][there, i])
    length[on] += left + right
    digest[on] = sha.hexed(sha.closed(state, left + right + 1))


# ---- batches -----------------------------------------------------------------------

def _characters(column: pa.Array) -> np.ndarray:
    """Strings of 64 characters as n x 64 bytes."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros((0, sha.BLOCK), np.uint8)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    low = offsets[column.offset]
    return data[low:low + sha.BLOCK * len(column)].reshape(-1, sha.BLOCK).copy()


def _strings(characters: np.ndarray) -> pa.Array:
    offsets = np.arange(len(characters) + 1, dtype=np.int32) * sha.BLOCK
    return pa.StringArray.from_buffers(len(characters), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(characters).tobytes()))


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, and for each row the running number of its
    block, from batches sorted by (tree, block); at most ``HELD`` rows and
    one block are held."""
    held: list[pa.RecordBatch] = []

    def numbered(rows: pa.Table) -> np.ndarray:
        tree, block = rows["tree"].to_numpy(), rows["block"].to_numpy()
        return np.cumsum((np.diff(tree, prepend=tree[:1]) != 0) | (np.diff(block, prepend=block[:1]) != 0))

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < HELD:
            continue
        rows = pa.Table.from_batches(held)
        number = numbered(rows)
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield rows.slice(0, cut).combine_chunks(), number[:cut]
            held = rows.slice(cut).combine_chunks().to_batches()
    if held and sum(map(len, held)):
        rows = pa.Table.from_batches(held)
        yield rows.combine_chunks(), numbered(rows)


def _array(rows: pa.Table, name: str) -> pa.Array:
    c = rows[name]
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tier upwards: each block becomes a node."""
    for rows, number in whole_blocks(batches):
        place, total = (rows[c].to_numpy() for c in ("place", "total"))
        heads = np.flatnonzero(np.diff(number, prepend=-1))
        _, ends = levels_of(_characters(_array(rows, "digest")), number, place, total)
        yield pa.RecordBatch.from_arrays([pa.array(rows["tree"].to_numpy()[heads]), pa.array(rows["block"].to_numpy()[heads]),
                                          pa.array(-(-total[heads] // BLOCK_LEAVES)), _strings(ends)], ["tree", "place", "total", "digest"])


def _split(rows: pa.Table, number: np.ndarray):
    """Members (rows with a digest), their blocks from 0 on, and the paths of
    the blocks' head rows."""
    head = _array(rows, "digest").is_null().to_numpy(zero_copy_only=False)
    heads = rows.filter(pa.array(head))
    index = np.cumsum(head) - 1
    paths = [np.frombuffer(p, STEP) for p in _array(heads, "path").to_pylist()]
    if len(paths) != number[-1] + 1 or not (index == number).all():
        raise ValueError("a block without its path")
    return rows.filter(pa.array(~head)), index[~head], heads, paths


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tier downwards: every member gets its path to the root."""
    for rows, number in whole_blocks(batches):
        members, block, _, paths = _split(rows, number)
        place, total = (members[c].to_numpy() for c in ("place", "total"))
        levels, _ = levels_of(_characters(_array(members, "digest")), block, place, total)
        node, own = np.arange(len(members)), [b""] * len(members)
        for level in levels:
            live = np.flatnonzero(level.live[level.parent[node]])
            for i, step in zip(live.tolist(), level.steps(node[live])):
                own[i] += step.tobytes()
            node = up(level, node)
        whole = [a + paths[b].tobytes() for a, b in zip(own, block.tolist())]
        yield pa.RecordBatch.from_arrays([_array(members, "tree"), pa.array(place), pa.array(whole, pa.binary())], ["tree", "place", "path"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest tier: leaf by leaf the proof, and the root that the claimed
    leaf folds to."""
    for rows, number in whole_blocks(batches):
        members, block, heads, paths = _split(rows, number)
        place, total = (members[c].to_numpy() for c in ("place", "total"))
        levels, _ = levels_of(_characters(_array(members, "digest")), block, place, total)
        n = len(members)
        node, digest = np.arange(n), _characters(_array(members, "claim"))
        proof, length = sha.begun(n), np.zeros(n, np.int64)
        for level in levels:
            live = np.flatnonzero(level.live[level.parent[node]])
            fold(digest, proof, length, level.steps(node[live]), live)
            node = up(level, node)
        tall = np.array([len(p) for p in paths], np.int64)
        for i in range(tall.max(initial=0)):
            steps = np.array([p[i] if i < len(p) else np.zeros((), STEP) for p in paths], STEP)
            live = np.flatnonzero(tall[block] > i)
            fold(digest, proof, length, steps[block[live]], live)
        pick = pa.array(block)
        yield pa.RecordBatch.from_arrays(
            [_array(members, "row"), _array(members, "digest"), _array(heads, "subroot").take(pick), _array(heads, "root").take(pick),
             _strings(sha.hexed(sha.closed(proof, length))), _strings(digest)],
            ["row", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


# ---- the job -------------------------------------------------------------------------

NODE = "tree bigint, place bigint, total bigint, digest string"


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / F.lit(float(BLOCK_LEAVES))).cast("bigint"))


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _tiers(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each tier, lowest first, and the one node each tree ends in."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    tiers = [nodes]
    while True:
        above = stored(_gathered(_in_blocks(tiers[-1].select("tree", "place", "total", "digest"))).mapInArrow(_reduce, NODE), f"{name}-{len(tiers)}")
        most = -(-most // BLOCK_LEAVES)
        if most <= 1:
            return tiers, above
        tiers.append(above)


def _with_heads(tier: DataFrame, heads: DataFrame) -> DataFrame:
    """Members of blocks behind their head rows (place -1, no digest)."""
    heads = heads.withColumn("place", F.lit(-1).cast("bigint"))
    return _gathered(_in_blocks(tier).unionByName(heads, allowMissingColumns=True))


def _paths(tier: DataFrame, heads: DataFrame, name: str) -> DataFrame:
    return stored(_with_heads(tier, heads).mapInArrow(_descend, "tree bigint, place bigint, path binary"), name)


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS,
             key: str = "doc_id", source: str = "source") -> DataFrame:
    """Key, source, leaf, subroot, root, proof_sha256, folded_root and
    verified of every row of ``docs``.  ``claimed`` replaces fields of the
    rows whose inclusion is checked (by default the rows as they are):
    folded_root is the root that follows from the claimed leaf and the row's
    siblings."""
    own = {f: F.col(f"`{f}`") for f in fields}
    leaves = docs.select(F.col(f"`{source}`").alias("src"), F.col(f"`{key}`").alias("id"),
                         leaf_hash(own).alias("digest"), leaf_hash(own | (claimed or {})).alias("claim"))
    src, every = F.col("src"), F.lit("")
    leaves, spans = in_ranges(leaves, src, ["id", "digest"], "merkle-leaves")
    # sources in their order; each is a tree
    sources, source_spans = in_ranges(spans.groupBy(F.col("g").alias("src")).agg(F.sum("rows").alias("leaves")), every, ["src"], "merkle-sources")
    sources = stored(placed(sources, source_spans, every).select(F.col("src").alias("__src"), F.col("place").alias("tree"), F.col("total").alias("sources")), "merkle-trees")
    spans = spans.join(sources.select("__src", "tree"), F.col("g").eqNullSafe(F.col("__src"))).drop("__src")
    nodes = placed(leaves, spans, src).select("tree", "place", "total", "digest", "claim", F.struct("id", "src").alias("row"))
    nodes = stored(nodes, "merkle-nodes")
    tiers, subroots = _tiers(nodes, "merkle-up")
    # the tree over the subroots
    top = subroots.join(sources.select("tree", "sources"), "tree")
    top = stored(top.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.col("sources").alias("total"), "digest"), "merkle-top")
    top_tiers, root = _tiers(top, "merkle-top")
    # and down again: block paths from the root to the leaves' blocks
    heads = root.select("tree", F.col("place").alias("block"), F.lit(b"").alias("path"))
    for i, tier in reversed(list(enumerate(top_tiers))):
        heads = _paths(tier, heads, f"merkle-down-top-{i}").select("tree", F.col("place").alias("block"), "path")
    heads = heads.select(F.col("block").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path")
    for i, tier in reversed(list(enumerate(tiers))[1:]):
        heads = _paths(tier, heads, f"merkle-down-{i}").select("tree", F.col("place").alias("block"), "path")
    ends = subroots.select("tree", F.col("digest").alias("subroot")).crossJoin(root.select(F.col("digest").alias("root")))     # one root
    folded = _with_heads(nodes, heads.join(ends, "tree")).mapInArrow(
        _folded, f"row {nodes.schema['row'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return folded.select(F.col("row.id").alias(key), F.col("row.src").alias(source), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def without_line_ends(text: Column, key: Column) -> Column:
    """``text`` without line feeds where the crc32 of the decimal ``key`` is even."""
    even = F.crc32(F.encode(key.cast("string"), "UTF-8")) % 2 == 0
    return F.when(even, F.translate(text, "\n", "")).otherwise(text)
