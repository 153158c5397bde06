"""Nearest neighbours by a block matrix join of int8 product tiles.

Query vectors and candidate vectors are dealt into blocks of bounded size;
each (query block, candidate block) pair is one tile.  Inside a tile the unit
vectors are quantised to int8 with one scale each; the integer product gives
every cosine with a proven bound of the quantisation error

    |q.c - sq*sc*(q8.c8)| <= |eq| * |c| + |q - eq| * |ec|

Pairs whose upper bound reaches the k-th best lower bound of their query
survive; their cosine is recomputed in double precision and merged into the
query's heap.  The tiles' heaps are merged by rank.  No survivor is lost, so
recall is 1 by construction (a test measures it against brute force).

Equal candidate vectors in a tile tie: only the k + 1 smallest ids of each are
kept, so a very common vector costs one column of the product.

Defined results: ids that are null and vectors that are null, empty, zero or
hold null or non-finite components take no part; vectors of different length
are not compared; of rows that share an id the one with the smallest vector
counts; ties go to the smaller id; with no candidates a query has no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.vectors import pack_vectors, unit, unpack, vector_type

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
STRIP = 2048                # candidates multiplied at once inside a tile


def _quantise(x: np.ndarray):
    """int8 values (as float32, for exact fast products), scales, norm of the
    rounding error, norm of what the int8 values stand for."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype("f4"), scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # integer sums stay exact in float32 up to 2**24, 1,024 terms of 127 * 127
    return sum((a[:, i:i + 1024] @ b[:, i:i + 1024].T).astype("f8") for i in range(0, a.shape[1], 1024))


def tile_top(qid, q, cid, c, k: int):
    """The k best candidates of each query of one tile: (query, id, score)."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    _, same = np.unique(c.view(f"V{c.shape[1] * 8}").ravel(), return_inverse=True)
    by = np.lexsort((cid, same))
    starts = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
    place = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    keep = np.sort(by[place <= k])
    cid, c = cid[keep], c[keep]

    uq, uc = unit(q), unit(c)
    q8, qs, qe, qn = _quantise(uq)
    c8, cs, ce, _ = _quantise(uc)
    heaps: list[list] = [[] for _ in qid]
    for at in range(0, len(cid), STRIP):
        ids, u = cid[at:at + STRIP], uc[at:at + STRIP]
        near = _product(q8, c8[at:at + STRIP]) * qs[:, None] * cs[None, at:at + STRIP]
        slack = qe[:, None] + qn[:, None] * ce[None, at:at + STRIP] + 1e-9
        near[qid[:, None] == ids[None, :]] = -np.inf
        low = near - slack
        if low.shape[1] >= k:
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            floor = np.full(len(qid), -np.inf)
        held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        i, j = np.nonzero((near + slack >= np.maximum(floor, held)[:, None]) & (near > -np.inf))
        score = np.einsum("ij,ij->i", uq[i], u[j]) if len(i) < 1 << 18 else np.concatenate(
            [np.einsum("ij,ij->i", uq[i[s:s + (1 << 18)]], u[j[s:s + (1 << 18)]])
             for s in range(0, len(i), 1 << 18)])
        for a, s, b in zip(i.tolist(), score.tolist(), ids[j].tolist()):
            heap, item = heaps[a], (s, -b)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
    return [(int(x), -b, s) for x, h in zip(qid, heaps) for s, b in h]


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            *, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest cosine for
    each row that ``is_query`` (a function of the id column) selects."""
    code = vector_type(vectors, vec_col)
    rows = pack_vectors(vectors, id_col, vec_col)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("vec", "dim")).alias("v")).select(
        "vec_id", "v.dim", "v.vec", is_query(F.col("vec_id")).alias("asks"))
    n, asking = vectors.agg(F.count("*"), F.count(F.when(is_query(F.col(id_col)), 1))).first()
    q_blocks, c_blocks = max(1, -(-asking // query_block)), max(1, -(-n // candidate_block))
    queries = rows.where("asks").select(
        F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"),
        F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(q_blocks)).cast("int").alias("qb"), "dim", "vec_id", "vec")
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
        F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(c_blocks)).cast("int").alias("cb"), "dim", "vec_id", "vec")

    def tile(left, right):
        empty = left.num_rows == 0 or right.num_rows == 0
        found = [] if empty else tile_top(
            left.column("vec_id").to_numpy(), unpack(left.column("vec"), code),
            right.column("vec_id").to_numpy(), unpack(right.column("vec"), code), k)
        q, v, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()),
                         "score": pa.array(s, pa.float64())})

    keys = ["qb", "cb", "dim"]
    tops = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        tile, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tops.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
