"""Embedding near-dedup by NN-descent.

A k-neighbour graph over the vectors of one label is started from random
hyperplane buckets and refined in rounds: at every vertex its neighbours are
joined with each other (neighbours of neighbours, ``a <- b -> c``), better
ones enter both lists, until few entries change.  Equal vectors are one
weighted vertex.  Edges at or above the threshold are kept and give the
components.

A list whose entries all reach the threshold is saturated: the vertex may
have more links than it holds, and they may lead out of its component.  Such
vertices get a second list, of the nearest vertices outside their component,
refined in the same way; links found there merge components, and the search
is repeated until it finds none.  A component's own members never fill that
list, so it is short at any group size.  Components are then compared member
by member in blocks of bounded size (counts leave the tasks, not pairs), so
the number of links is exact for what the graph connects.

Recall is audited per vertex, by component size: of each power of two a
bounded, hashed sample is compared with every vector of its label.  If the
sampled vertices of one size miss too large a share of their links, the graph
is extended from fresh hyperplanes and refined again; if that does not mend it
either, the vectors of a label are all compared, in tiles.

Defined results: labels that differ or are null, and vectors that are null,
empty, zero, non-finite or of different length, never link; such rows come
back alone (their own component, no links); rows with a null id come back
with a null component; repeated ids are separate rows that share an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import connected_components, stored
from tidemark.llm.vectors import pack_vectors, unit, unpack, vector_type

THRESHOLD = 0.98
NEIGHBOURS = 8              # list length before it is enlarged
TABLES = 12                 # hyperplane bucketings a graph is started from
BUCKET = 16                 # wanted vectors in a bucket
BUCKET_MOST = 64            # larger buckets are dealt into parts
ROUNDS = 6                  # of refinement
SETTLED = 0.002             # share of changed entries that ends it
AUDIT = 256                 # vertices of each size of component compared with everything
RECALL = 0.99               # wanted of a vertex's links, on average in each size
RESTARTS = 3
BLOCK = 1024                # members of a component compared at once

EDGE = "src string, dst string, sim double"


def _edges(src, dst, sim) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.string()), "dst": pa.array(dst, pa.string()),
                     "sim": pa.array(sim, pa.float64())})


def _bits(points: DataFrame) -> int:
    """Hyperplanes that leave about ``BUCKET`` vectors of the largest label in a bucket."""
    largest = points.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    return int(min(24, max(1, round(np.log2(max(2, largest / BUCKET))))))


def _apart(t: pa.Table) -> np.ndarray:
    """Which pairs of rows are of different components."""
    of = np.unique(t.column("component").to_numpy(), return_inverse=True)[1]
    return of[:, None] != of[None, :]


def _bucket_edges(points: DataFrame, code: str, tables: int, seed: int, k: int) -> DataFrame:
    """The ``k`` nearest inside each random hyperplane bucket; of points with a
    ``component``, the nearest of other components."""
    bits = _bits(points)
    across = ["component"] if "component" in points.columns else []

    def codes(batches):
        for b in batches:
            out = np.zeros((b.num_rows, tables), "i8")
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                planes = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * bits))
                x = unit(unpack(b.column("vec").take(pa.array(at)), code))
                signs = (x @ planes > 0).reshape(len(at), tables, bits)
                out[at] = (signs << np.arange(bits)).sum(axis=2)
            flat = pa.array(out.ravel())
            ends = pa.array(np.arange(0, out.size + 1, tables, dtype="i4"))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(ends, flat)], [*b.schema.names, "codes"])

    coded = points.mapInArrow(codes, points._jdf.schema().toDDL() + ", codes array<long>")
    dealt = coded.select("node", "label", "dim", "vec", *across, F.posexplode("codes").alias("t", "code"))
    keys = ["label", "dim", "t", "code"]
    sizes = coded.select("label", "dim", F.posexplode("codes").alias("t", "code")).groupBy(*keys).count()
    large = sizes.where(F.col("count") > BUCKET_MOST).withColumn(
        "parts", F.ceil(F.col("count") / BUCKET_MOST).cast("int"))
    dealt = dealt.join(large.drop("count"), keys, "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("node", "t", F.lit(seed)), F.col("parts")), F.lit(0)))

    def near(t: pa.Table) -> pa.Table:
        n = t.num_rows
        if n < 2:
            return _edges([], [], [])
        x = unit(unpack(t.column("vec"), code))
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        if across:
            sim[~_apart(t)] = -2
        most = min(k, n - 1)
        best = np.argpartition(-sim, most - 1, axis=1)[:, :most].ravel()
        nodes = np.array(t.column("node").to_pylist(), object)
        src = np.repeat(np.arange(n), most)
        real = sim[src, best] > -2
        src, best = src[real], best[real]
        return _edges(nodes[src], nodes[best], sim[src, best])

    return dealt.select(*keys, "part", "node", "vec", *across).groupBy(*keys, "part").applyInArrow(near, EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each vertex's ``k`` best distinct neighbours; arcs count both ways."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    one = both.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    order = W.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return one.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def _local_join(graph: DataFrame, points: DataFrame, code: str, k: int, inner: DataFrame | None = None) -> DataFrame:
    """New arcs between two neighbours of one vertex, if they improve a list.
    ``inner`` has further arcs, inside of components, that lead to neighbours;
    the lists are then of vertices outside the component."""
    worst = graph.groupBy("src").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    worst = worst.select(F.col("src").alias("dst"), F.when(F.col("n") < k, -2.0).otherwise(F.col("worst")).alias("worst"))
    across = [] if inner is None else ["component"]
    side = points.select(F.col("node").alias("dst"), "vec", *across).join(worst, "dst", "left" if across else "inner")
    arcs = graph.select("src", "dst") if inner is None else graph.select("src", "dst").unionByName(inner)
    lists = arcs.join(side, "dst").select("src", "dst", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"), *across)

    def join(t: pa.Table) -> pa.Table:
        if t.num_rows < 2:
            return _edges([], [], [])
        x = unit(unpack(t.column("vec"), code))
        sim = x @ x.T
        worst = t.column("worst").to_numpy()
        better = sim > np.minimum(worst[:, None], worst[None, :])
        i, j = np.nonzero(np.triu(better & _apart(t) if across else better, 1))
        nodes = np.array(t.column("dst").to_pylist(), object)
        return _edges(nodes[i], nodes[j], sim[i, j])

    return lists.groupBy("src").applyInArrow(join, EDGE)


def _refine(graph: DataFrame, points: DataFrame, code: str, k: int, rounds: int, n: int,
            inner: DataFrame | None = None) -> DataFrame:
    """``graph`` after rounds of local joins, until few entries change."""
    for _ in range(rounds):
        better = graph.unionByName(_local_join(graph, points, code, k, inner))
        refined = stored(_best(better, k), "nn-graph")
        changed = refined.join(graph, ["src", "dst"], "left_anti").count()
        graph = refined
        if changed <= SETTLED * max(1, n * k):
            break
    return graph


def _components(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id")))
    return stored(connected_components(
        ends.distinct(), links.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "nn-components")


def _outward(points: DataFrame, graph: DataFrame, comps: DataFrame, code: str, threshold: float, k: int,
             tables: int, rounds: int, seed: int) -> DataFrame | None:
    """Links between components at vertices whose lists are full of links;
    None if there are none.  A link that no list holds has such vertices at
    both ends."""
    full = graph.groupBy("src").agg(F.min("sim").alias("worst"), F.count("*").alias("n")).where(
        (F.col("n") >= k) & (F.col("worst") >= threshold)).select(F.col("src").alias("node"))
    full = points.select("node", "label", "dim", "vec").join(full, "node").join(
        comps.withColumnRenamed("id", "node"), "node")
    several = full.groupBy("label", "dim").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(
        "a < b").select(F.col("label").alias("__label"), F.col("dim").alias("__dim"))
    full = stored(full.join(several, F.col("label").eqNullSafe(F.col("__label")) & (F.col("dim") == F.col("__dim")),
                            "left_semi"), "nn-full")
    n = full.count()
    if not n:
        return None
    inner = stored(graph.select("src", "dst").join(full.select(F.col("node").alias("src")), "src", "left_semi")
                   .join(full.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "nn-inner")
    across = stored(_best(_bucket_edges(full, code, tables, seed, k), k), "nn-graph")
    across = _refine(across, full, code, k, rounds, n, inner)
    found = stored(across.where(F.col("sim") >= threshold), "nn-outward")
    return None if found.isEmpty() else found


def _audit(points: DataFrame, comps: DataFrame, code: str, threshold: float, sample: int) -> float:
    """Share of a sampled vertex's links that lie inside its component: the
    mean over vertices that have links, least of all sizes of component."""
    at = points.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")).select("node", "label", "dim", "vec", "component")
    at = stored(at, "nn-audit")
    sizes = at.groupBy("component").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("size"))
    order = W.partitionBy("size").orderBy(F.xxhash64("node", F.lit("audit")), "node")
    picked = at.select("node", "component").join(sizes, "component").withColumn(
        "at", F.row_number().over(order)).where(F.col("at") <= sample).select("node", "size")
    picked = at.join(picked, "node").collect()
    ask: dict = {}
    for r in picked:                    # at most ``sample`` rows a power of two
        ask.setdefault((r.label, r.dim), []).append(r)
    ask = {key: ([r.node for r in rows], [r.component for r in rows],
                 unit(np.frombuffer(b"".join(bytes(r.vec) for r in rows), code).reshape(len(rows), -1).astype("f8")))
           for key, rows in ask.items()}

    def against(batches):
        for b in batches:
            labels, dims = b.column("label").to_pylist(), b.column("dim").to_pylist()
            comp = np.array(b.column("component").to_pylist(), object)
            nodes = np.array(b.column("node").to_pylist(), object)
            at_key: dict = {}
            for i, key in enumerate(zip(labels, dims)):
                at_key.setdefault(key, []).append(i)
            out, there, inside = [], [], []
            for key, rows in at_key.items():
                if key not in ask:
                    continue
                qn, qc, q = ask[key]
                x = unit(unpack(b.column("vec").take(pa.array(rows)), code))
                near = q @ x.T >= threshold
                for qi in np.flatnonzero(near.any(axis=1)):
                    met = np.array(rows)[near[qi]]
                    met = met[nodes[met] != qn[qi]]
                    if len(met):
                        out.append(qn[qi])
                        there.append(len(met))
                        inside.append(int((comp[met] == qc[qi]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(there, pa.int64()),
                                              pa.array(inside, pa.int64())], ["node", "there", "inside"])

    size = {r.node: r.size for r in picked}
    shares: dict = {}
    for r in at.mapInArrow(against, "node string, there long, inside long").groupBy("node").agg(
            F.sum("there").alias("there"), F.sum("inside").alias("inside")).collect():
        shares.setdefault(size[r.node], []).append(r.inside / r.there)
    return min((float(np.mean(x)) for x in shares.values()), default=1.0)


def _all_links(points: DataFrame, comps: DataFrame, code: str, threshold: float) -> DataFrame:
    """Links between components, one for each two of a tile: every vector is
    compared with all others of its label."""
    member = points.select("node", "label", "dim", "vec").join(comps.withColumnRenamed("id", "node"), "node", "left")
    member = member.withColumn("component", F.coalesce("component", "node")).withColumn(
        "g", F.xxhash64("label", F.col("label").isNull(), "dim"))
    sizes = member.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = stored(member.join(sizes, "g").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "nn-blocks")
    columns = ["label", "dim", "component", "node", "vec"]
    left = member.select("g", F.col("block").alias("i"),
                         F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *columns)
    right = member.select("g", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), *columns)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        groups: list[dict] = [{}, {}]
        for got, t in zip(groups, (a, b)):
            for i, key in enumerate(zip(t.column("label").to_pylist(), t.column("dim").to_pylist())):
                got.setdefault(key, []).append(i)
        found: dict = {}
        for key, rows in groups[0].items():
            if key not in groups[1]:
                continue
            ra, rb = a.take(pa.array(rows)), b.take(pa.array(groups[1][key]))
            sim = unit(unpack(ra.column("vec"), code)) @ unit(unpack(rb.column("vec"), code)).T
            ca, cb = (np.array(t.column("component").to_pylist(), object) for t in (ra, rb))
            na, nb = (t.column("node").to_pylist() for t in (ra, rb))
            for i, j in zip(*np.nonzero((sim >= threshold) & (ca[:, None] != cb[None, :]))):
                found[min(ca[i], cb[j]), max(ca[i], cb[j])] = (na[i], nb[j], sim[i, j])
        return _edges(*([x[c] for x in found.values()] for c in range(3)))

    keys = ["g", "i", "j"]
    return stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, EDGE), "nn-all")


def _degrees(points: DataFrame, comps: DataFrame, code: str, threshold: float) -> DataFrame:
    """``(node, linked)``: weight of the members of its component, itself
    included, that reach the threshold; blocks of a component meet in tiles."""
    member = points.join(comps.withColumnRenamed("id", "node"), "node")
    sizes = member.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = member.join(sizes, "component").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # components of one block are bundled, or each would be a group of its own
    bundle = F.when(F.col("blocks") > 1, F.xxhash64("component")).otherwise(
        F.pmod(F.xxhash64("component"), F.lit(4096)))
    left = member.select(bundle.alias("g"), F.col("block").alias("i"), F.explode(others).alias("j"),
                         "component", "node", "vec")
    right = member.select(bundle.alias("g"), F.explode(others).alias("i"), F.col("block").alias("j"),
                          *[F.col(c).alias(c) for c in ("component", "node", "vec", "weight")])

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        nodes, linked = [], []
        groups = [{}, {}]
        for got, t in zip(groups, (a, b)):
            for i, c in enumerate(t.column("component").to_pylist()):
                got.setdefault(c, []).append(i)
        for c, rows in groups[0].items():
            if c in groups[1]:
                ra, rb = a.take(pa.array(rows)), b.take(pa.array(groups[1][c]))
                sim = unit(unpack(ra.column("vec"), code)) @ unit(unpack(rb.column("vec"), code)).T
                na, nb = ra.column("node").to_numpy(), rb.column("node").to_numpy()
                sim[na[:, None] == nb[None, :]] = 1.0
                nodes += na.tolist()
                linked += ((sim >= threshold) @ rb.column("weight").to_numpy()).tolist()
        return pa.table({"node": pa.array(nodes, pa.string()), "linked": pa.array(linked, pa.int64())})

    keys = ["g", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        count, "node string, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", *, threshold: float = THRESHOLD, k: int = NEIGHBOURS,
                    tables: int = TABLES, rounds: int = ROUNDS, audit: int = AUDIT,
                    recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    code = vector_type(vectors, vec_col)
    rows = stored(pack_vectors(vectors, id_col, vec_col, label_col), "nn-rows")
    points = stored(rows.groupBy("node").agg(
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"),
        F.count("*").alias("weight"), F.min("vec_id").alias("least")), "nn-points")
    n = points.count()

    graph = extra = None
    for restart in range(RESTARTS + 1):
        start = _bucket_edges(points, code, tables, 1 + restart, k)
        graph = stored(_best(start if graph is None else graph.unionByName(start), k), "nn-graph")
        graph = _refine(graph, points, code, k, rounds, n)
        links = graph.where(F.col("sim") >= threshold)
        links = links if extra is None else links.unionByName(extra)
        comps = _components(links)
        seed = 1000 * (1 + restart)
        while (more := _outward(points, graph, comps, code, threshold, k, tables, rounds, seed)) is not None:
            extra = more if extra is None else extra.unionByName(more)
            links, seed = links.unionByName(more), seed + 1
            comps = _components(links)
        if _audit(points, comps, code, threshold, audit) >= recall:
            break
    else:
        comps = _components(links.unionByName(_all_links(points, comps, code, threshold)))

    linked = _degrees(points, comps, code, threshold)
    lowest = points.join(comps.withColumnRenamed("id", "node"), "node").groupBy("component").agg(
        F.min("least").alias("low"))
    info = (points.select("node", "least", "weight").join(comps.withColumnRenamed("id", "node"), "node", "left")
            .join(lowest, "component", "left").join(linked, "node", "left")
            .select("node", F.coalesce("low", "least").alias("component_id"),
                    (F.coalesce("linked", "weight") - 1).alias("n_links")))
    used = rows.select("vec_id", "node").join(info, "node").select("vec_id", "n_links", "component_id")
    # rows that take no part: those of the input the packed table lacks
    all_ids = vectors.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.count("*").alias("n"))
    have = rows.groupBy("vec_id").agg(F.count("*").alias("m"))
    rest = all_ids.join(have, "vec_id", "left").select("vec_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"))
    alone = rest.where("n > 0").select(F.explode(F.array_repeat("vec_id", F.col("n").cast("int"))).alias("vec_id"))
    out = used.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
