"""Exact Jaccard join of documents' n-gram sets through pivots.

A document is its set of distinct word n-grams (64-bit hashes).  Documents
with equal sets are one node.  Two nodes link when
``100 * intersection >= percent * union``.

Regions.  Documents are no useful pivots for whole text collections: unrelated
texts share no n-gram, so every distance is 1 and every window holds
everything (the README has figures).  The pivots of the first level are
therefore single n-grams in one global order (frequent ones last, else by
hash): a node's Voronoi cell is that of its first n-gram.  If x and y link, at
most ``(100 - percent)%`` of x is missing in y; counted on the n-grams before
a pivot, the symmetric difference is a metric, and its triangle inequality
says that x can meet y only at one of its first ``floor((100 - percent)% of
|x|) + 1`` pivots.  x is replicated to exactly these windows.

Joining a region.  A document pivot (the leader) is compared with all members;
what links is merged.  Small regions also give their other pairs that pass the
size and position bounds; those inside a component go.  Large regions whose
members are by then one component are settled, because links inside a component
change nothing.  The others are split once, with their component labels, and
not again: members outside the region's main component meet all members, in
tiles of bounded size, where distances to a document of the tile prune pairs by
the triangle inequality, and only links that join two components leave the
task.  No pair that could link is left out, so components are exact.

Sketches.  A set's sketch has a bit per bucket of n-grams: the parity of their
number.  Two sets differ in at least as many n-grams as their sketches in bits,
so most pairs that share a rare n-gram by chance go before a set is sent
anywhere, and no pair that links goes.  Tiles run on sketches first; only
members that still may link outside their component meet again as sets.

The order needs n-grams held by more than ``HOT_SHARE`` of the documents.
Tasks report n-grams frequent among their own documents; the list's length is
at most (mean set size / HOT_SHARE * 2), and any list gives the same result.

Defined results: null or empty text, or one without words, has the empty set
and links with nothing; with fewer words than n, all of them are one gram; a
null id sorts after all others and comes back null; rows that share an id or
repeat are separate rows, linked like any other; input columns other than id
and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import LAST_ID, connected_components, stored

WORDS = 4
PERCENT = 85
HOT_SHARE = 0.0002
LOCAL_GRAMS = 3 << 19           # n-grams a task gathers before it merges their counts
SMALL = 64                      # members up to which a region gives pairs
TILE = 1024                     # members of one side of a tile
BROADCAST_IDS = 1_000_000
STRIP = 2 << 20                 # bytes of text hashed at once
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """n-gram hashes of many texts at once."""

    def __init__(self, words: int):
        self.words = words
        letters = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
        upper = np.arange(65, 91)
        letters[upper] = letters[upper + 32]            # A-Z as a-z
        self.letters = letters
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n + 1:
            n = max(n + 1, STRIP + (STRIP >> 2))
            one = np.ones(1, np.uint64)
            self.power = np.cumprod(np.concatenate([one, np.full(n, BASE, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([one, np.full(n, INVERSE, np.uint64)]))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct n-gram hashes of each text."""
        none = np.zeros(0, np.uint64)
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self._powers(len(data))
        gap = self.blank[data]
        edge = np.diff(np.concatenate([[True], gap]).astype("i1"))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            return [none for _ in texts]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.power[:len(data)])])
        word = mixed((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(start, ends)             # words before the end of each text
        n = self.words
        gram = np.zeros(len(word), np.uint64)
        for i in range(n):
            gram[:len(word) - i] += word[i:] * np.uint64((BASE * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
        gram = mixed(gram)
        out, first = [], 0
        for last in upto.tolist():
            if last - first >= n:
                out.append(np.unique(gram[first:last - n + 1]))
            elif last > first:
                x = np.array([last - first], np.uint64)
                for i in range(first, last):
                    x = mixed(x * np.uint64(31) + word[i:i + 1])
                out.append(x)
            else:
                out.append(none)
            first = last
        return out


def _strips(batch):
    """``(first row, texts)`` of bounded size."""
    held, size, first = [], 0, 0
    for i, t in enumerate(batch.to_pylist()):
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= STRIP:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def hot_grams(text: DataFrame, words: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams and their counts, sorted by n-gram."""

    def local(batches):
        hasher, held, docs, keys, counts = Hasher(words), [], 0, np.zeros(0, np.uint64), np.zeros(0, "i8")

        def merge():
            k, at = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts, np.ones(len(at) - len(keys), "i8")])).astype("i8")
            keep = n >= (1 if len(k) < LOCAL_GRAMS else 2)      # bounded: rare ones are let go
            return k[keep], n[keep]

        for b in batches:
            for _, texts in _strips(b.column(0)):
                held += hasher.sets(texts)
                docs += len(texts)
                if sum(map(len, held)) > LOCAL_GRAMS:
                    (keys, counts), held = merge(), []
        if docs:
            keys, counts = merge()
            often = counts >= max(2, int(docs * share))
            for i in range(0, int(often.sum()), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[often][i:i + (1 << 16)].view("i8")),
                                                  pa.array(counts[often][i:i + (1 << 16)])], ["gram", "n"])

    n_docs = text.count()
    seen = text.mapInArrow(local, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    got = seen.where(F.col("n") >= max(4, int(n_docs * share / 2))).toArrow()
    gram, n = got.column("gram").to_numpy().view("u8"), got.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def _node(x: np.ndarray, seed: int) -> tuple[int, int]:
    import hashlib

    d = hashlib.blake2b(x.tobytes(), digest_size=16, salt=seed.to_bytes(4, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(x: np.ndarray) -> bytes:
    """Parities of ``x`` over a power of two of buckets, more than it has n-grams."""
    bits = max(64, 1 << len(x).bit_length())
    return np.packbits(np.bincount((x & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) over ``width`` words: buckets merge in twos."""
    while x.shape[-1] > width:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def may_link(x: np.ndarray, y: np.ndarray, nx, ny, percent: int) -> np.ndarray:
    """Whether sets of ``nx`` and ``ny`` n-grams with these sketches can link:
    ``100 * both >= percent * (nx + ny - both)``, where the sketches differ in
    at most ``nx + ny - 2 * both`` bits."""
    width = min(x.shape[-1], y.shape[-1])
    apart = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(axis=-1, dtype="i8")
    return (100 + percent) * (nx + ny - apart) >= 2 * percent * (nx + ny)


def _by_width(sketches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equally long sketches and these as one array."""
    size = np.array([len(s) for s in sketches])
    out = []
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        out.append((at, np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), "<u8").reshape(len(at), -1)))
    return out


ROWS = "id long, n long, node long, check long, window array<long>, sketch binary"


def document_rows(docs: DataFrame, hot, words: int, percent: int, seed: int) -> DataFrame:
    """Per document its set's size and node, and, once per node and task, the
    n-grams of its window and its sketch."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def rows(batches):
        hasher, seen = Hasher(words), set()
        hot_gram, hot_n = held.value
        for b in batches:
            for first, texts in _strips(b.column("text")):
                ids = b.column("id").slice(first, len(texts))
                n, node, check, window, sketches = [], [], [], [], []
                for x in hasher.sets(texts):
                    k, c = _node(x, seed) if len(x) else (None, None)
                    n.append(len(x))
                    node.append(k)
                    check.append(c)
                    if k is None or k in seen:
                        window.append(None)
                        sketches.append(None)
                        continue
                    seen.add(k)
                    sketches.append(sketch(x))
                    if len(hot_gram):
                        at = np.minimum(np.searchsorted(hot_gram, x), len(hot_gram) - 1)
                        often = hot_gram[at] == x
                        if often.any():
                            late = x[often][np.argsort(hot_n[at[often]], kind="stable")]
                            x = np.concatenate([x[~often], late])
                    window.append(x[:(100 - percent) * len(x) // 100 + 1].view("i8"))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()),
                     pa.array(window, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["id", "n", "node", "check", "window", "sketch"])

    return stored(docs.mapInArrow(rows, ROWS), "jaccard-rows")


def _first_pairs(regions: DataFrame, percent: int) -> DataFrame:
    """From region rows sorted by n-gram: pairs to compare (``kind`` 0 with
    the region's leader, ``kind`` 2 others) and the rows of large regions
    (``kind`` 1: n-gram, node)."""

    def scan(batches):
        carry: list[np.ndarray] = [np.zeros(0, "i8")] * 3
        leader = None                   # (n-gram, node, size) of the large region that goes on

        def run(g, node, size, place, whole):
            """One region, or a part of a large one."""
            nonlocal leader
            if whole and leader is None:
                if len(node) <= SMALL:
                    i, j = np.triu_indices(len(node), 1)
                    need = -(-percent * (size[i] + size[j]) // (100 + percent))
                    most = 1 + np.minimum(size[i] - place[i], size[j] - place[j]) - 1
                    ok = most >= need
                    lead, rest = ok & (i == 0), ok & (i > 0)
                    return [(0, node[i][lead], node[j][lead]), (2, node[i][rest], node[j][rest])]
            if leader is None:
                leader = (g, node[0], size[0])
            near = (percent * np.maximum(size, leader[2]) <= 100 * np.minimum(size, leader[2])) & (node != leader[1])
            return [(0, np.full(int(near.sum()), leader[1]), node[near]), (1, np.full(len(node), g), node)]

        def emit(parts):
            for kind, a, b in parts:
                for i in range(0, len(a), 1 << 16):
                    x, y = a[i:i + (1 << 16)], b[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), kind, "i4")), pa.array(x), pa.array(y)], ["kind", "a", "b"])

        def step(g, node, packed, last):
            """Finished regions of sorted rows; the open one is carried on."""
            nonlocal leader, carry
            new = np.ones(len(g), bool)         # a node of several tasks counts once
            new[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
            g, node, packed = g[new], node[new], packed[new]
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(g)].astype(int)
            multi = ends - starts > 1
            multi[:1] |= leader is not None
            if not last and len(multi):
                multi[-1] = True
            parts = []
            for s, e in zip(starts[multi].tolist(), ends[multi].tolist()):
                if leader is not None and leader[0] != g[s]:
                    leader = None
                if e == len(g) and not last:
                    if e - s <= 4 * SMALL and leader is None:
                        carry = [g[s:], node[s:], packed[s:]]
                        return parts
                    parts += run(g[s], node[s:e], packed[s:e] >> 32, packed[s:e] & 0xFFFFFFFF, False)
                    carry = [g[e - 1:], node[e - 1:], packed[e - 1:]]     # only to tell repeats
                    return parts
                parts += run(g[s], node[s:e], packed[s:e] >> 32, packed[s:e] & 0xFFFFFFFF, True)
                leader = None
            carry = [np.zeros(0, "i8")] * 3
            return parts

        for b in batches:
            cols = [np.concatenate([c, b.column(i).to_numpy()]) for i, c in enumerate(carry)]
            yield from emit(step(*cols, False))
        if len(carry[0]):
            yield from emit(step(*carry, True))

    return stored(regions.mapInArrow(scan, "kind int, a long, b long"), "jaccard-pairs")


def node_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, seed: int) -> DataFrame:
    """``(node, grams)`` of ``nodes(node)``, from one document of each."""
    ids = stored(rows.join(nodes, "node").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct(), "jaccard-wanted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def sets(batches):
        hasher = Hasher(words)
        for b in batches:
            for _, texts in _strips(b.column("text")):
                got = [x for x in hasher.sets(texts) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(x, seed)[0] for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())],
                    ["node", "grams"])

    # ids that repeat bring other nodes along, which no pair asks for, or a
    # node twice, which gives a pair twice
    return stored(docs.join(ids, "id", "left_semi").mapInArrow(sets, "node long, grams binary"), "jaccard-sets")


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, kind)`` whose sketches let them link."""
    left, right = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def compare(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            sb, na, nb = b.column("sb").to_pylist(), b.column("na").to_numpy(), b.column("nb").to_numpy()
            for at, x in _by_width(b.column("sa").to_pylist()):
                for inner, y in _by_width([sb[i] for i in at.tolist()]):
                    both = at[inner]
                    keep[both] = may_link(x[inner], y, na[both], nb[both], percent)
            yield b.select(["a", "b", "kind"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "kind", "na", "nb", "sa", "sb").mapInArrow(
        compare, "a long, b long, kind int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ga").to_pylist(), b.column("gb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(compare, "a long, b long")


def _tiles(members: DataFrame, held: DataFrame, *columns: str):
    """Both sides of the tiles of unsettled large regions: members outside the
    main component, and all members, with ``columns`` of ``held(node, ..)``."""
    per = members.groupBy("g", "comp").agg(F.count("*").alias("k"))
    shape = per.groupBy("g").agg(F.sum("k").alias("k"), F.max(F.struct("k", "comp")).alias("main"), F.count("*").alias("c"))
    shape = shape.where("c > 1").select(
        "g", F.col("main.comp").alias("main"), F.ceil(F.col("k") / TILE).cast("int").alias("across"),
        F.ceil((F.col("k") - F.col("main.k")) / TILE).cast("int").alias("down"))
    open_ = members.join(shape, "g").join(held.dropDuplicates(["node"]), "node")
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = open_.where("comp <> main").select("g", slot("down").alias("i"), each("across").alias("j"), "node", "comp", *columns)
    right = open_.select(F.col("g").alias("g"), each("down").alias("i"), slot("across").alias("j"),
                         *[F.col(c).alias(c) for c in ("node", "comp", *columns)])
    return left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j"))


def _live_members(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``(g, node)`` of the members of large regions that may link outside
    their component, as far as sketches tell."""

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        live: set = set()
        if a.num_rows and b.num_rows:
            g = a.column("g")[0].as_py()
            nx, cx, kx = (a.column(c).to_numpy() for c in ("n", "comp", "node"))
            ny, cy, ky = (b.column(c).to_numpy() for c in ("n", "comp", "node"))
            xs = [np.frombuffer(x, "<u8") for x in a.column("sketch").to_pylist()]
            for at, y in _by_width(b.column("sketch").to_pylist()):
                n, c, k = ny[at], cy[at], ky[at]
                for i, x in enumerate(xs):
                    may = np.flatnonzero((percent * np.maximum(n, nx[i]) <= 100 * np.minimum(n, nx[i])) & (c != cx[i]))
                    if len(may):
                        may = may[may_link(x, y[may], nx[i], n[may], percent)]
                        if len(may):
                            live.add(int(kx[i]))
                            live.update(k[may].tolist())
        node = sorted(live)
        return pa.table({"g": pa.array([g] * len(node) if node else [], pa.int64()), "node": pa.array(node, pa.int64())})

    return _tiles(members, sketches, "n", "sketch").applyInArrow(tile, "g long, node long").distinct()


def _tile_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components inside unsettled large regions.
    ``members(g, node, comp)``."""
    gap = 1 - percent / 100 + 1e-9

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list = []
        if a.num_rows and b.num_rows:
            xs = [np.frombuffer(x, np.uint64) for x in a.column("grams").to_pylist()]
            ys = [np.frombuffer(y, np.uint64) for y in b.column("grams").to_pylist()]
            nx, ny = a.column("node").to_pylist(), b.column("node").to_pylist()
            size = np.array([len(y) for y in ys])
            all_y, starts = np.concatenate(ys), np.cumsum(size) - size
            parent: dict = {}

            def root(c):
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            cx, cy = a.column("comp").to_pylist(), b.column("comp").to_pylist()

            def shared(x):
                at = np.minimum(np.searchsorted(x, all_y), len(x) - 1)
                return np.add.reduceat((x[at] == all_y).astype("i8"), starts)

            def distance(x, both):
                return 1 - both / (len(x) + size - both)

            from_pivot = distance(ys[0], shared(ys[0]))         # the tile's document pivot
            for i, x in enumerate(xs):
                both = len(np.intersect1d(x, ys[0], assume_unique=True))
                here = 1 - both / (len(x) + len(ys[0]) - both)
                own = root(cx[i])
                may = (percent * np.maximum(size, len(x)) <= 100 * np.minimum(size, len(x))) & (
                    np.abs(from_pivot - here) <= gap)
                may &= np.array([root(c) != own for c in cy])
                if not may.any():
                    continue
                both = shared(x)
                for j in np.flatnonzero(may & (100 * both >= percent * (len(x) + size - both))).tolist():
                    p, q = root(cx[i]), root(cy[j])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((nx[i], ny[j]))
        p, q = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(p, pa.int64()), "b": pa.array(q, pa.int64())})

    return _tiles(members, sets, "grams").applyInArrow(tile, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                       words: int = WORDS, percent: int = PERCENT, hot_share: float = HOT_SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).alias("text"))
    hot = hot_grams(base.select("text"), words, hot_share)
    for seed in range(8):
        rows = document_rows(base, hot, words, percent, seed)
        nodes = rows.where("node is not null").groupBy("node").agg(
            F.min("id").alias("least"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        nodes = stored(nodes, "jaccard-nodes")
        if not nodes.where("c0 <> c1").limit(1).count():
            break           # else two sets share a 64-bit node id: hashed anew
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    regions = rows.where("window is not null").select(
        "node", "n", F.posexplode("window").alias("at", "g")).select(
        "g", "node", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("packed"))
    regions = regions.repartition(width, "g").sortWithinPartitions("g", "node")
    found = _first_pairs(regions, percent)
    pairs = found.where("kind <> 1").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("kind").alias("kind"))
    large = found.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("node"))
    sketches = rows.where("sketch is not null").select("node", "n", "sketch").dropDuplicates(["node"])
    near = stored(_near(pairs, sketches, percent), "jaccard-near")
    sets = node_sets(base, rows, near.select(F.col("a").alias("node")).unionAll(near.select("b")).distinct(), words, seed)
    links = stored(_verified(near.where("kind = 0").drop("kind"), sets, percent), "jaccard-links")
    ids = nodes.select(F.col("node").alias("id"))
    first = stored(connected_components(ids, links).withColumnRenamed("id", "node"), "jaccard-components")
    of = lambda x: first.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    others = near.where("kind = 2").join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("a", "b")
    more = stored(_verified(others, sets, percent), "jaccard-links")
    members = large.join(first, "node").select("g", "node", F.col("component").alias("comp"))
    live = stored(_live_members(members, sketches, percent), "jaccard-live")
    if live.limit(1).count():
        sets = node_sets(base, rows, live.select("node").distinct(), words, seed)
        tiled = _tile_links(members.join(live, ["g", "node"]), sets, percent)
        more = stored(more.unionByName(tiled), "jaccard-links")
    final = first
    if more.limit(1).count():
        final = connected_components(ids, links.unionByName(more)).withColumnRenamed("id", "node")
        final = stored(final, "jaccard-components")
    low = nodes.join(final, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    named = final.join(low, "component").select("node", "component_id")
    out = rows.join(named, "node", "left")
    back = lambda c: F.when(c == LAST_ID, None).otherwise(c)
    return out.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      back(F.coalesce("component_id", "id")).alias("component_id"))
