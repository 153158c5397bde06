import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, sha_states as sha

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Root of a list of digests, and for each the siblings on its way."""
    ways, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for j in run:
                for leaf_index in at[j]:
                    ways[leaf_index].append(([nodes[k] for k in run if k < j], [nodes[k] for k in run if k > j]))
        at = [[x for j in run for x in at[j]] for run in runs]
        nodes = [H(*[nodes[k] for k in run]) for run in runs]
    return nodes[0], ways


def brute(rows, tamper=True):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built, out = [], []
    for s in order:
        members = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built.append((members, *climb([leaf(r) for r in members])))
    if not rows:
        return []
    root, top = climb([subroot for _, subroot, _ in built])
    for (members, subroot, ways), above in zip(built, top):
        for r, way in zip(members, ways):
            changed = r
            if tamper and r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                changed = (*r[:4], r[4].replace("\n", ""))
            got = leaf(changed)
            for left, right in way + above:
                got = H(*left, got, *right)
            proof = H(*[x for left, right in way + above for x in left + right])
            out.append((r[0], r[1], leaf(r), subroot, root, proof, got, got == root))
    return sorted(out, key=str)


def rows_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = merkle.manifest(docs, {"text": merkle.without_line_ends(F.col("text"), F.col("doc_id"))}, **more)
    return sorted([tuple(r) for r in out.collect()], key=str)


def some(rng, n, sources):
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i * 7]), rng.choice([None, "", "é\nü", "a\n" * (i % 5), "plain"])) for i in range(n)]


def test_states_are_sha256():
    rng = np.random.default_rng(1)
    assert sha.START[0] == 0x6A09E667 and sha.ROUND[0] == 0x428A2F98
    for blocks in (0, 1, 2, 5):
        data = rng.integers(0, 256, (7, blocks, 64)).astype(np.uint8)
        state = sha.begun(7)
        for b in range(blocks):
            state = sha.advanced(state, data[:, b])
        got = sha.hexed(sha.closed(state, np.full(7, blocks)))
        assert [bytes(g).decode() for g in got] == [hashlib.sha256(d.tobytes()).hexdigest() for d in data]


@pytest.mark.parametrize("n", [1, 3, 10, 200])
def test_trees_of_all_shapes_match_brute_force(spark, n):
    rng = random.Random(n)
    rows = some(rng, n, ["a", "b", "B", "é", None, "hot", "hot", "hot", "hot", "hot"])
    assert rows_of(spark, rows) == brute(rows)


def test_many_tiers_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 3)
    monkeypatch.setattr(merkle, "HELD", 8)
    rng = random.Random(4)
    rows = some(rng, 90, ["a", "b", None, *["s%02d" % i for i in range(9)], *["hot"] * 20])
    assert rows_of(spark, rows) == brute(rows)


def test_nulls_repeats_long_texts_and_extra_columns(spark):
    rows = [(1, "a", None, None, None)] * 4 + [(None, None, None, None, None), (None, None, None, None, "x\n"), (2, "", "", 0, ""), (2, "", "", 0, "other"),
            (3, "a", "en", 9, "line é\n" * 300000), (4, None, "-", -1, "-")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "place", "digest", "row", "src", "leaf", "a.b"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = merkle.manifest(docs)
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute(rows, tamper=False)
    assert all(r.verified for r in out.collect())


def test_empty_table(spark):
    assert rows_of(spark, []) == []
