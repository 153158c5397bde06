import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann_tiles, nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int"
BAD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]


def cosine(a, b):
    a, b = np.asarray(a, "f8"), np.asarray(b, "f8")
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


def vectors(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype("f4")
    for i in range(copies):
        x[n - 1 - i] = x[i // 2] + rng.standard_normal(dim).astype("f4") * 0.05
    return x


def test_tiles_match_brute_force(spark):
    x = vectors(300, 16, 1, copies=60)
    x[100:120] = x[7]                                    # a very common vector: ties
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ann_tiles.nearest(df, lambda c: c % 10 == 0, k=5, query_block=8, candidate_block=64).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 300, 10):
        want = sorted(((-cosine(x[q], x[c]), c) for c in range(300) if c != q))[:5]
        got = [found[q][k] for k in range(1, 6)]
        assert np.allclose([s for _, s in got], [-s for s, _ in want], atol=1e-12)
        hits += len({i for i, _ in got} & {c for _, c in want})
    assert hits / 150 >= 0.95                           # equal scores may differ in the last bit


def test_tiles_take_no_unusable_vectors(spark):
    rows = [(i, v, 0) for i, v in enumerate(BAD)] + [(10, [1.0, 0.0, 0.0], 0), (20, [1.0, 1.0, 0.0], 0), (20, [1.0, 1.0, 0.0], 0),
            (None, [1.0, 0.0, 0.0], 0), (30, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("mine")).withColumn("dim", F.lit(1))
    out = ann_tiles.nearest(df, lambda c: c % 10 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(10, 1, 20), (20, 1, 10)]
    assert ann_tiles.nearest(spark.createDataFrame([], SCHEMA), lambda c: c % 10 == 0).count() == 0


def components(x, labels, threshold):
    n, parent = len(x), list(range(len(x)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    degree = [0] * n
    for a in range(n):
        for b in range(a):
            if labels[a] == labels[b] and labels[a] is not None and cosine(x[a], x[b]) >= threshold:
                degree[a] += 1
                degree[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return degree, [root(i) for i in range(n)]


def test_descent_matches_brute_force(spark):
    x = vectors(240, 24, 2, copies=80)
    x[150:170] = x[150]                                  # equal vectors
    labels = [i % 3 if i % 17 else None for i in range(240)]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], labels[i]) for i in range(240)], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(df).collect()}
    degree, root = components(x, labels, 0.98)
    assert sum(degree) > 50
    assert out == {i: (degree[i], root[i], root[i] == i) for i in range(240)}


def dense_groups(n, dim, seed):
    """Two groups of one label, links inside about .999 and across about .985,
    and two more with one link across."""
    rng = np.random.default_rng(seed)
    noise = lambda m: rng.standard_normal((m, dim)) * np.sqrt(0.0005 / dim)
    base, aside, far = np.linalg.qr(rng.standard_normal((dim, 3)))[0].T
    turn = lambda u, v, c: c * u + np.sqrt(1 - c * c) * v
    near = [base + noise(n), turn(base, aside, 0.985) + noise(n)]
    apart = [far + noise(n), turn(far, aside, 0.955) + noise(n)]
    apart[0][0] = turn(far, aside, 0.995)           # at .978 of the other group but for one vector
    apart[1][0] = turn(far, aside, 0.968)
    return np.concatenate(near + apart).astype("f4")


@pytest.mark.parametrize("options", [{}, {"tables": 1, "rounds": 1, "recall": 1.1}])
def test_descent_links_dense_groups(spark, options):
    x = dense_groups(20, 32, 5)
    labels = [0] * len(x)
    degree, root = components(x, labels, 0.98)
    assert len(set(root)) == 2 and min(degree) > nn_descent.NEIGHBOURS
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(len(x))], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(df, **options).collect()}
    assert out == {i: (degree[i], root[i], root[i] == i) for i in range(len(x))}


def test_descent_audits_small_groups(spark):
    x = vectors(600, 24, 8)
    x[:500] = x[0] + vectors(500, 24, 9) * 0.01     # a group with nearly all links
    x[500:600:2] = x[501:600:2] * 1.5 + 0.01        # pairs
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(600)], SCHEMA)
    points = nn_descent.pack_vectors(df, "vec_id", "embedding", "label")
    comps = points.where("vec_id < 500").select(F.col("node").alias("id"), F.lit("0").alias("component"))
    assert nn_descent._audit(points, comps, "<f4", 0.98, 64) < 0.5


def test_descent_with_unusable_rows(spark):
    rows = [(i, v, 1) for i, v in enumerate(BAD)] + [(10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.01, 0.0], 1), (12, [1.0, 0.0, 0.0], None),
            (None, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0], 1), (14, [5.0, 5.0, 0.0], 2), (14, [5.0, 5.0, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("mine"))
    out = sorted((tuple(r) for r in nn_descent.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 12, 13)] + [(10, 1, 10, True), (11, 1, 10, False), (None, 0, None, False),
                                                                     (14, 1, 14, True), (14, 1, 14, True)]
    assert out == sorted(want, key=str)


def test_descent_of_empty_table(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim", [3, 1500])
def test_quantisation_bound_holds(dim):
    x, y = ann_tiles.unit(vectors(40, dim, 3).astype("f8")), ann_tiles.unit(vectors(50, dim, 4).astype("f8"))
    q, qs, qe, qn = ann_tiles._quantise(x)
    c, cs, ce, _ = ann_tiles._quantise(y)
    error = np.abs(ann_tiles._product(q, c) * qs[:, None] * cs[None, :] - x @ y.T)
    assert (error <= qe[:, None] + qn[:, None] * ce[None, :] + 1e-9).all()
