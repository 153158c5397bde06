"""All datasets trained, tuned and compared in one run, against plain loops."""
import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import additive_fit, tree_fit
from tidemark.operators import aggregates as agg
from tidemark.operators import features as fe
from tidemark.operators import grouped_training as grp
from tidemark.operators.forecast import compile_nodes, predict_trees
from tidemark.operators.training import changepoints_for
from tidemark.plans.forecasting import forecast_run
from tidemark.schema import FEATURE_COLS

SCHEMA = ("dataset_id long, order_date date, product string, category string, region string, "
          "quantity double, unit_price double, revenue double, cost double")


def sales_of(spark, days_by_dataset, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for ds, days in days_by_dataset.items():
        for i in range(days):
            rev = 100.0 * ds + 30 * math.sin(i / 5) + 20 * (i % 7) + float(rng.normal() * 5)
            rows.append((ds, dt.date(2023, 1, 1) + dt.timedelta(days=i), "P", "C", "NS"[i % 2], 1.0, rev, rev, None))
    return spark.createDataFrame(rows, SCHEMA)


# ---- plain versions ------------------------------------------------------------

def plain_split(x, y, w, rows, l2, least):
    """Best (gain, feature, threshold) over all midpoints, by loops."""
    best = (-np.inf, None, None)
    g, n = (y * w)[rows].sum(), w[rows].sum()
    for f in range(x.shape[1]):
        values = np.unique(x[rows, f])
        for a, b in zip(values, values[1:]):
            left = rows[x[rows, f] <= a]
            if min(len(left), len(rows) - len(left)) < least:
                continue
            gl, nl = (y * w)[left].sum(), w[left].sum()
            gain = gl ** 2 / (nl + l2) + (g - gl) ** 2 / (n - nl + l2) - g ** 2 / (n + l2)
            if gain > best[0] + 1e-9 * (1 + abs(gain)):
                best = (gain, f, (a + b) / 2)
    return best


def plain_tree(x, y, w, l2=0.0, least=1, max_depth=math.inf, max_leaves=None):
    """Nodes {path: (feature, threshold, value)}; a path is a string of L and R."""
    nodes = {}

    def add(path, rows):
        nodes[path] = [None, None, (y * w)[rows].sum() / (w[rows].sum() + l2)]
        return path, rows, plain_split(x, y, w, rows, l2, least) if len(path) < max_depth and len(rows) > 1 else (-np.inf, None, None)

    open_leaves, leaves = [add("", np.flatnonzero(w > 0))], 1
    while open_leaves:
        if max_leaves:
            at = max(range(len(open_leaves)), key=lambda i: open_leaves[i][2][0])
        else:
            at = 0
        path, rows, (gain, f, threshold) = open_leaves.pop(at)
        if not gain > 1e-9 * ((y ** 2 * w).sum() + 1e-300) or (max_leaves and leaves >= max_leaves):
            continue
        nodes[path][:2] = f, threshold
        leaves += 1
        open_leaves += [add(path + "L", rows[x[rows, f] <= threshold]), add(path + "R", rows[x[rows, f] > threshold])]
    return nodes


def as_paths(tree):
    out, todo = {}, [(0, "")]
    while todo:
        i, path = todo.pop()
        leaf = tree.left[i] < 0
        out[path] = [None if leaf else tree.feature[i], None if leaf else tree.threshold[i], tree.value[i]]
        if not leaf:
            todo += [(tree.left[i], path + "L"), (tree.right[i], path + "R")]
    return out


def grown(x, y, w, **spec):
    codes, low, high = tree_fit.coded(x, spec.pop("max_bins", None))
    codes = np.ascontiguousarray(codes.T)
    order = np.argsort(codes, axis=1, kind="stable")
    order = order[w[order] > 0].reshape(len(codes), -1)
    return tree_fit.grow(order, codes, low, high, np.arange(len(codes)), y, w, spec)


def same(got, want):
    assert got.keys() == want.keys()
    for p in want:
        assert got[p][0] == want[p][0]
        assert got[p][1] == pytest.approx(want[p][1]) and got[p][2] == pytest.approx(want[p][2])


def table(seed, n=120, f=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, f))
    x[:, 0] = rng.integers(0, 5, n)
    return x, 3 * x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=n), rng


# ---- trees -----------------------------------------------------------------------

@pytest.mark.parametrize("l2,least", [(0.0, 1), (1.0, 1), (0.0, 7)])
def test_levelwise_tree_equals_plain_loops(l2, least):
    x, y, _ = table(1)
    same(as_paths(grown(x, y, np.ones(len(y)), max_depth=4, l2=l2, min_leaf=least)), plain_tree(x, y, np.ones(len(y)), l2, least, 4))


def test_leafwise_tree_equals_plain_loops_and_grows_unevenly():
    x, y, _ = table(2)
    y = y + np.exp(3 * x[:, 1])
    got = as_paths(grown(x, y, np.ones(len(y)), num_leaves=12, min_leaf=3))
    same(got, plain_tree(x, y, np.ones(len(y)), 0.0, 3, max_leaves=12))
    leaves = [p for p, v in got.items() if v[0] is None]
    assert len(leaves) == 12 and max(map(len, leaves)) > math.ceil(math.log2(12)) > min(map(len, leaves))


def test_weighted_tree_equals_plain_loops():
    x, y, rng = table(3, 80)
    w = np.bincount(rng.integers(0, 80, 80), minlength=80).astype(float)
    same(as_paths(grown(x, y, w)), plain_tree(x, y, w))


def test_boosting_equals_plain_loops():
    x, y, _ = table(4, 60)
    nodes = tree_fit.fit_ensemble(x, y, {"n_estimators": 5, "max_depth": 2, "rate": 0.3}, 1)
    pred = np.full(len(y), y.mean())
    for _ in range(5):
        tree = plain_tree(x, y - pred, np.ones(len(y)), max_depth=2)
        step = np.zeros(len(y))
        for i, row in enumerate(x):
            p = ""
            while tree[p][0] is not None:
                p += "L" if row[tree[p][0]] <= tree[p][1] else "R"
            step[i] = tree[p][2]
        pred += 0.3 * step
    got = predict_trees(compile_nodes(nodes.assign(average=False)), x)
    assert np.abs(got - pred).max() < 1e-9


def test_bins_keep_order_and_bound():
    x = np.arange(1000.0)[:, None] ** 2
    codes, low, high = tree_fit.coded(x, 16)
    assert codes.max() + 1 == 16 and (np.diff(codes[:, 0]) >= 0).all()
    assert (low[0] <= high[0]).all() and (high[0][:-1] < low[0][1:]).all()


def test_constant_target_and_single_row():
    for x, y in ((np.ones((5, 2)), np.zeros(5)), (np.ones((1, 2)), np.array([4.0]))):
        for spec in ({"n_estimators": 3, "max_depth": 3, "rate": .1}, {"n_estimators": 3}, {"n_estimators": 2, "num_leaves": 31, "rate": .1, "min_leaf": 20}):
            nodes = tree_fit.fit_ensemble(x, y, spec, 1)
            assert np.allclose(predict_trees(compile_nodes(nodes.assign(average="rate" not in spec)), x), y)


# ---- the job -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def run(spark):
    return grp.train_grouped(sales_of(spark, {1: 90, 2: 70, 3: 10, 4: 33}))


def test_compares_all_algorithms_and_records_refusals(run):
    rows = run.registry.collect()
    assert {(r.dataset_id, r.algorithm) for r in rows} == {(d, a) for d in (1, 2) for a in grp.AVAILABLE_ALGORITHMS}
    for d in (1, 2):
        mine = [r for r in rows if r.dataset_id == d]
        assert [r.algorithm for r in mine if r.is_active] == [min(mine, key=lambda r: r.mae).algorithm]
    assert not any("approximation" in r.implementation for r in rows)
    assert {r.dataset_id: r.error.split(" ")[1] for r in run.errors.collect()} == {3: "enough", 4: "enough"}
    assert {r.error for r in run.errors.where("dataset_id = 4").collect()} == {"Not enough usable rows after feature engineering."}


def test_leafwise_model_differs_from_levelwise(spark, run):
    path = run.registry.where("kind = 'nodes'").first().file_path
    nodes = spark.read.parquet(path).where("dataset_id = 1 and algorithm = 'lightgbm' and left < 0")
    assert nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0] <= 31


def test_number_of_jobs_does_not_depend_on_datasets(spark):
    sc, counts = spark.sparkContext, []
    for n in (1, 6):
        sales = sales_of(spark, {i + 1: 60 for i in range(n)}).cache()
        sales.count()
        group = f"grouped-{n}"
        sc.setJobGroup(group, group)
        grp.train_grouped(sales, algorithms=["gradient_boosting", "prophet"]).registry.collect()
        counts.append(len(sc.statusTracker().getJobIdsForGroup(group)))
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_first_forecast_step_is_the_model_on_rebuilt_features(spark, run):
    sales = sales_of(spark, {1: 90, 2: 70, 3: 10, 4: 33})
    reg = run.registry.where("algorithm = 'lightgbm'").withColumn("is_active", F.lit(True))
    points = forecast_run(type(run)(**{**run.__dict__, "registry": reg}), sales, horizon=2).where("step = 1").collect()
    daily = agg.daily_revenue(sales.where("dataset_id in (1, 2)"))
    last = daily.groupBy("dataset_id").agg(F.date_add(F.max("order_date"), 1).alias("order_date"))
    feats = fe.build_features(daily.unionByName(last, allowMissingColumns=True), drop_warmup=False).join(last, ["dataset_id", "order_date"])
    x = {r["dataset_id"]: np.array([[float(r[c]) for c in FEATURE_COLS]]) for r in feats.collect()}
    nodes = spark.read.parquet(reg.first().file_path).where("algorithm = 'lightgbm'").toPandas().assign(average=False)
    assert {p.dataset_id for p in points} == {1, 2}
    for p in points:
        want = predict_trees(compile_nodes(nodes[nodes.dataset_id == p.dataset_id]), x[p.dataset_id])[0]
        assert p.predicted_revenue == pytest.approx(max(want, 0.0), rel=1e-9)


def test_search_equals_a_plain_loop(spark, monkeypatch):
    points = {"gradient_boosting": [{"n_estimators": 5, "max_depth": 2, "learning_rate": 0.1}, {"n_estimators": 20, "max_depth": 3, "learning_rate": 0.3}],
              "random_forest": [{"n_estimators": 4, "max_depth": 3, "min_samples_leaf": 2}, {"n_estimators": 3, "max_depth": None, "min_samples_leaf": 1}]}
    monkeypatch.setattr(grp, "draws_of", points.get)
    rng = np.random.default_rng(5)
    rows = [(d, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(d * i + rng.normal()), [float(i % 7), float(rng.normal()), float(i)])
            for d in (1, 2) for i in range(40 + d)]
    train = spark.createDataFrame(rows, "dataset_id long, order_date date, revenue double, x array<double>")
    got = {(r.dataset_id, r.algorithm): r for r in grp.tuned(train, ["dataset_id"], list(points)).collect()}
    assert len(got) == 4
    for d in (1, 2):
        x, y = (np.array([r[k] for r in rows if r[0] == d]) for k in (3, 2))
        folds = np.array_split(np.arange(len(y)), 3)
        for a, draws in points.items():
            maes = []
            for params in draws:
                each = []
                for held in folds:
                    rest = np.setdiff1d(np.arange(len(y)), held)
                    nodes = tree_fit.fit_ensemble(x[rest], y[rest], grp.spec_of(a, params), grp.SEED).assign(average=a == "random_forest")
                    each.append(np.abs(predict_trees(compile_nodes(nodes), x[held]) - y[held]).mean())
                maes.append(np.mean(each))
            assert json.loads(got[d, a].params) == draws[int(np.argmin(maes))]
            assert got[d, a].cv_mae == pytest.approx(min(maes))


def test_a_failing_fit_is_an_error_row_and_the_others_go_on(spark, monkeypatch):
    monkeypatch.setitem(grp.DEFAULT_PARAMS, "xgboost", {"n_estimators": "many", "max_depth": 4, "learning_rate": .1})
    out = grp.train_grouped(sales_of(spark, {1: 60}), algorithms=["xgboost", "gradient_boosting", "unknown"])
    assert [r.algorithm for r in out.registry.collect()] == ["gradient_boosting"]
    errors = [r.error for r in out.errors.collect()]
    assert len(errors) == 1 and "xgboost" in errors[0]


# ---- the additive model ----------------------------------------------------------

def additive_case(n=400):
    rng = np.random.default_rng(7)
    t = np.arange(n, dtype=float)
    y = 50 + 0.3 * t + 0.8 * np.maximum(t - 150, 0) + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n)
    cps = changepoints_for(n)
    return additive_fit.design(t + 19000, t, cps, grp.PERIODS), y, len(cps)


def test_additive_without_penalty_is_least_squares():
    x, y, k = additive_case()
    coefficients, intercept = additive_fit.fit(x, y, k, scale=None)
    direct = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    fitted = x @ coefficients + intercept
    assert np.abs(fitted - np.column_stack([np.ones(len(x)), x]) @ direct).max() < 1e-8 * np.abs(y).max()


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(8)
    z, y = rng.normal(size=(200, 12)), rng.normal(size=200) * 3
    z[:, 5:] += z[:, :1]
    lasso, ridge = np.where(np.arange(12) > 3, 15.0, 0.0), np.full(12, 0.5)
    b = additive_fit.descend(z.T @ z, z.T @ y, lasso, ridge, np.zeros(12))
    slope = z.T @ (y - z @ b) - ridge * b
    zero = b == 0
    assert zero.any() and (~zero).any()
    assert (np.abs(slope[zero]) <= lasso[zero] + 1e-6).all()
    assert np.abs(slope[~zero] - lasso[~zero] * np.sign(b[~zero])).max() < 1e-5


def test_penalty_keeps_few_changepoints():
    x, y, k = additive_case()
    coefficients, intercept = additive_fit.fit(x, y, k)
    assert (coefficients[1:1 + k] == 0).sum() > k // 3
    assert np.abs(x @ coefficients + intercept - y).mean() < 2.0


def test_additive_predictions_equal_the_design(spark):
    sales = sales_of(spark, {1: 80})
    out = grp.train_grouped(sales, algorithms=["prophet"])
    row = out.registry.first()
    p = json.loads(row.hyperparameters)
    points = forecast_run(out, sales, horizon=3).orderBy("step").collect()
    t = np.arange(80.0, 83.0)
    day = t + (dt.date(2023, 1, 1) - dt.date(1970, 1, 1)).days
    want = additive_fit.design(day, t, p["changepoints"], grp.PERIODS) @ np.array(p["coefficients"]) + p["intercept"]
    assert [x.predicted_revenue for x in points] == pytest.approx(np.maximum(want, 0).tolist())
    assert all(x.lower_bound <= x.predicted_revenue <= x.upper_bound for x in points)


def test_store_is_retrained_and_predicts_from_stored_nodes(spark, tmp_path):
    from tidemark.plans import workflow as wf
    from tidemark.sinks.store import Store
    from tidemark.streaming.file_ingest import ingest_uploads
    store, paths = Store(spark, str(tmp_path / "tables")), []
    for name, days in (("a", 70), ("b", 60), ("short", 5)):
        p = tmp_path / f"{name}.csv"
        p.write_text("Date,Revenue\n" + "".join(f"{dt.date(2024, 1, 1) + dt.timedelta(days=i)},{100 + i % 7}\n" for i in range(days)))
        paths.append(str(p))
    ingest_uploads(spark, paths, store)
    ids = {r.original_filename: r.dataset_id for r in store.datasets().collect()}
    run = wf.retrain(store, ["gradient_boosting", "prophet"])
    assert store.models().count() == 4
    assert [r.dataset_id for r in run.errors.collect()] == [ids["short.csv"]]
    assert run.registry.where("kind = 'nodes'").first().file_path.startswith(store.root)
    for name in ("a.csv", "b.csv"):
        for algorithm in ("gradient_boosting", "prophet"):
            assert len(wf.predict(spark, store, ids[name], horizon=3, algorithm=algorithm).collect()) == 3
    assert store.predictions().count() == 12
