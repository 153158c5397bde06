"""Model training and comparison (TRN1-TRN9) on MLlib.

One model per dataset (the reference's granularity).  The feature panel is
written once, partitioned by the dataset keys, to the shared folder; each
fit reads only its own partition (partition pruning), and fits for all
datasets and algorithms are submitted concurrently from a driver thread
pool — Spark schedules their jobs side by side.  Test predictions of every
model are evaluated in one grouped Spark job (EVL1-3) and the best model
per dataset is flagged by MOD1.  Nothing data-sized reaches the driver:
only dataset keys, row counts and model parameters do.
"""

from __future__ import annotations

import datetime as dt
import itertools
import hashlib
import json
import re
import math
import os
import random
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import aggregates as agg
from tidemark.operators import features as fe
from tidemark.operators.metrics import evaluate
from tidemark.operators.selection import new_version, pick_best
from tidemark.schema import (AVAILABLE_ALGORITHMS, FEATURE_COLS, MIN_FEATURE_ROWS,
                             MIN_SALES_ROWS)
from tidemark.session import shared_path

# ---------------------------------------------------------------------------
# FIXED VALUES — default hyperparameters and search grids to reproduce.
# ---------------------------------------------------------------------------
SEED = 42
DEFAULT_PARAMS = {
    "gradient_boosting": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1},
    "random_forest": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1},
    "xgboost": {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.05,
                "subsample": 0.9, "colsample_bytree": 0.9},
    "lightgbm": {"n_estimators": 200, "num_leaves": 31, "learning_rate": 0.05},
    "prophet": {"weekly_seasonality": True, "yearly_seasonality": True,
                "daily_seasonality": False},
}
PARAM_GRIDS = {
    "gradient_boosting": {"n_estimators": [100, 200], "max_depth": [2, 3, 4],
                          "learning_rate": [0.01, 0.05, 0.1]},
    "random_forest": {"n_estimators": [100, 200], "max_depth": [None, 5, 10],
                      "min_samples_leaf": [1, 2, 4]},
    "xgboost": {"n_estimators": [100, 200], "max_depth": [3, 4, 6],
                "learning_rate": [0.01, 0.05, 0.1]},
    "lightgbm": {"n_estimators": [100, 200], "num_leaves": [15, 31],
                 "learning_rate": [0.01, 0.05, 0.1]},
}
TUNE_DRAWS = 4
TUNE_FOLDS = 3
# Additive seasonal model: weekly and yearly Fourier orders, changepoints.
WEEKLY_ORDER, YEARLY_ORDER = 3, 10
N_CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
BAND_QUANTILES = (0.1, 0.9)

MLLIB_MAX_DEPTH = 30   # MLlib's depth cap stands in for "unlimited"
MAX_BINS = 128


def leaves_to_depth(num_leaves: int) -> int:
    """Depth-wise stand-in for a leaf-wise learner: smallest depth whose
    full tree has at least ``num_leaves`` leaves."""
    return max(1, math.ceil(math.log2(num_leaves)))


def _xgboost_spark():
    try:  # optional, used when installed
        from xgboost.spark import SparkXGBRegressor  # type: ignore
        return SparkXGBRegressor
    except Exception:  # noqa: BLE001
        return None


def make_estimator(algorithm: str, params: dict, label: str = "revenue",
                   features_col: str = "features"):
    """Map reference hyperparameters to an MLlib estimator.  Returns
    (estimator, implementation label)."""
    common = dict(labelCol=label, featuresCol=features_col, seed=SEED, maxBins=MAX_BINS)
    if algorithm == "gradient_boosting":
        return GBTRegressor(maxIter=params["n_estimators"], maxDepth=params["max_depth"],
                            stepSize=params["learning_rate"], **common), "mllib.GBTRegressor"
    if algorithm == "random_forest":
        depth = params.get("max_depth") or MLLIB_MAX_DEPTH
        return RandomForestRegressor(
            numTrees=params["n_estimators"], maxDepth=depth,
            minInstancesPerNode=params.get("min_samples_leaf", 1),
            featureSubsetStrategy="all", maxMemoryInMB=1024, cacheNodeIds=True, **common,
        ), "mllib.RandomForestRegressor"
    if algorithm == "xgboost":
        native = _xgboost_spark()
        if native is not None:
            return native(label_col=label, features_col=features_col,
                          n_estimators=params["n_estimators"], max_depth=params["max_depth"],
                          learning_rate=params["learning_rate"],
                          subsample=params.get("subsample", 1.0),
                          colsample_bytree=params.get("colsample_bytree", 1.0),
                          random_state=SEED), "xgboost.spark"
        return GBTRegressor(maxIter=params["n_estimators"], maxDepth=params["max_depth"],
                            stepSize=params["learning_rate"],
                            subsamplingRate=params.get("subsample", 1.0),
                            featureSubsetStrategy=str(params.get("colsample_bytree", 1.0)),
                            **common), "mllib.GBTRegressor (approximation)"
    if algorithm == "lightgbm":
        return GBTRegressor(maxIter=params["n_estimators"],
                            maxDepth=leaves_to_depth(params["num_leaves"]),
                            stepSize=params["learning_rate"], **common
                            ), "mllib.GBTRegressor depth-wise (approximation)"
    raise ValueError(f"no estimator for {algorithm}")


def sample_param_maps(algorithm: str, draws: int = TUNE_DRAWS, seed: int = SEED) -> list[dict]:
    """TRN7: ``draws`` seeded random points of the algorithm's grid."""
    grid = PARAM_GRIDS[algorithm]
    names = list(grid)
    points = [dict(zip(names, vals)) for vals in itertools.product(*grid.values())]
    return random.Random(seed).sample(points, min(draws, len(points)))


# ---------------------------------------------------------------------------
# Additive seasonal model (trend + changepoints + Fourier seasonality)
# ---------------------------------------------------------------------------

def additive_terms(date_col: str, t_col: str, changepoints: Sequence[float]) -> list[Column]:
    """Design columns: trend t, hinge max(0, t - c) per changepoint, weekly
    and yearly Fourier pairs on the absolute day number."""
    day = F.datediff(F.col(date_col), F.lit(dt.date(1970, 1, 1))).cast("double")
    t = F.col(t_col).cast("double")
    cols = [t.alias("_trend")]
    cols += [F.greatest(t - F.lit(c), F.lit(0.0)).alias(f"_cp{i}")
             for i, c in enumerate(changepoints)]
    for name, period, order in (("w", 7.0, WEEKLY_ORDER), ("y", 365.25, YEARLY_ORDER)):
        for k in range(1, order + 1):
            ang = day * (2.0 * math.pi * k / period)
            cols += [F.sin(ang).alias(f"_{name}s{k}"), F.cos(ang).alias(f"_{name}c{k}")]
    return cols


def additive_term_names(n_changepoints: int) -> list[str]:
    names = ["_trend"] + [f"_cp{i}" for i in range(n_changepoints)]
    for name, order in (("w", WEEKLY_ORDER), ("y", YEARLY_ORDER)):
        for k in range(1, order + 1):
            names += [f"_{name}s{k}", f"_{name}c{k}"]
    return names


def changepoints_for(n_train: int) -> list[float]:
    """Evenly spaced over the first 80 % of the training days."""
    hi = max(int(n_train * CHANGEPOINT_RANGE), 1)
    n = min(N_CHANGEPOINTS, max(hi - 1, 0))
    return [float(round(hi * (i + 1) / (n + 1))) for i in range(n)]


# ---------------------------------------------------------------------------
# Run
# ---------------------------------------------------------------------------

@dataclass
class TrainingRun:
    version: str
    registry: DataFrame            # one row per (dataset, algorithm)
    errors: DataFrame              # datasets refused by the data guards
    panel_path: str
    daily_path: str
    keys: list[str]
    models: dict = field(default_factory=dict)   # (key tuple, algorithm) -> info


def _key_filter(keys: Sequence[str], values: Sequence) -> Column:
    cond = F.lit(True)
    for k, v in zip(keys, values):
        cond = cond & (F.col(k) == F.lit(v))
    return cond


def _write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """``df`` by key, read back with its own schema: keys that became folder
    names (``01``, ``1``) keep their type."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def model_folder(values: Sequence) -> str:
    """A folder name of one dataset's models that no other key shares and
    that no file system or URI encodes."""
    plain = json.dumps([str(v) for v in values])
    readable = re.sub("[^A-Za-z0-9]+", "-", "_".join(str(v) for v in values)).strip("-")[:40]
    return f"{readable}-{hashlib.sha1(plain.encode()).hexdigest()[:16]}"


def train_and_compare(
    sales: DataFrame,
    keys: Sequence[str] = ("dataset_id",),
    algorithms: Sequence[str] = AVAILABLE_ALGORITHMS,
    test_size: float = 0.2,
    tune: bool = False,
    model_root: str | None = None,
    parallelism: int = 8,
    version: str | None = None,
    trained_at: dt.datetime | None = None,
    pooled: bool = False,
) -> TrainingRun:
    """TRN6/TRN9: train every requested algorithm for every dataset,
    evaluate on the chronological test split, flag the best per dataset.
    Unknown algorithms are skipped; a failing fit is logged in ``errors``.

    ``pooled=True`` fits each tree algorithm once over all datasets' panels
    with a per-dataset index as an extra feature (``series_index``), instead
    of one fit per dataset: the number of MLlib fits no longer grows with
    the number of datasets.  Metrics, selection and registry rows stay per
    dataset; the additive model stays per dataset."""
    spark: SparkSession = sales.sparkSession
    keys = list(keys)
    if not 0.0 < test_size < 0.5:
        raise ValueError("test_size must be in (0, 0.5)")
    version = version or new_version()
    trained_at = trained_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    run_dir = shared_path(spark, "runs", f"{version}_{uuid.uuid4().hex[:6]}")
    model_root = model_root or shared_path(spark, "models")

    # Daily series (with sales-row counts for the guard) written once.
    daily = agg.daily_revenue(sales, keys, with_counts=True)
    daily_path = os.path.join(run_dir, "daily")
    daily = _write_partitioned(daily, daily_path, keys)
    feats = fe.chrono_split(fe.build_features(daily, keys), keys, test_size)
    feats = feats.withColumn("series_index", series_index(keys))
    cols = FEATURE_COLS + (["series_index"] if pooled else [])
    feats = VectorAssembler(inputCols=cols, outputCol="features").transform(feats)
    panel_path = os.path.join(run_dir, "panel")
    panel = _write_partitioned(feats, panel_path, keys)

    # TRN8 guards: one small aggregate per dataset (metadata-sized collect).
    sales_rows = daily.groupBy(*keys).agg(F.sum("n_rows").alias("n_sales"))
    feat_rows = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"))
    guard = sales_rows.join(feat_rows, keys, "left").fillna(0, ["n_features"])
    guard_rows = guard.collect()
    ok, refused = [], []
    for r in guard_rows:
        kv = tuple(r[k] for k in keys)
        if r["n_sales"] < MIN_SALES_ROWS:
            refused.append(kv + ("Not enough historical data to train a model.",))
        elif r["n_features"] < MIN_FEATURE_ROWS:
            refused.append(kv + ("Not enough usable rows after feature engineering.",))
        else:
            ok.append(kv)

    wanted = [a for a in algorithms if a in AVAILABLE_ALGORITHMS]
    if pooled:
        tasks = [(None, a) for a in wanted if a != "prophet"]
        tasks += [(kv, a) for kv in ok for a in wanted if a == "prophet"]
    else:
        tasks = [(kv, a) for kv in ok for a in wanted]
    results: dict = {}
    failures: list = []

    def run(task):
        kv, algorithm = task
        served = ok if kv is None else [kv]
        try:
            if kv is None:
                info = _fit_pooled(spark, panel, keys, ok, algorithm, tune, model_root, version)
            else:
                info = _fit_one(spark, panel, daily, keys, kv, algorithm, test_size, tune,
                                model_root, version)
            for k in served:
                results[(k, algorithm)] = info
        except Exception as exc:  # noqa: BLE001  (TRN6: a failing fit is recorded)
            for k in served:
                failures.append(k + (f"Training '{algorithm}' failed: {exc}",))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        list(pool.map(run, tasks))

    err_schema = T.StructType([*(T.StructField(k, f.dataType) for k in keys
                                 for f in guard.schema.fields if f.name == k),
                               T.StructField("error", T.StringType())])
    errors = spark.createDataFrame(refused + failures, err_schema)

    # Evaluate all test predictions in one grouped job, then pick the best.
    if results:
        preds, seen = None, set()
        for info in results.values():
            if id(info) in seen:          # a pooled fit serves many datasets
                continue
            seen.add(id(info))
            p = info["test_predictions"]
            preds = p if preds is None else preds.unionByName(p)
        metrics = evaluate(preds, keys + ["algorithm"])
        metrics = pick_best(metrics, keys, list(algorithms))
        meta_rows = [kv + (a, info["file_path"], info["kind"], info["implementation"],
                           json.dumps(info["params"], default=str), bool(info.get("pooled")))
                     for (kv, a), info in results.items()]
        meta_schema = T.StructType(
            [f for f in err_schema.fields if f.name in keys]
            + [T.StructField(n, T.StringType()) for n in
               ("algorithm", "file_path", "kind", "implementation", "hyperparameters")]
            + [T.StructField("pooled", T.BooleanType())])
        meta = spark.createDataFrame(meta_rows, meta_schema)
        registry = metrics.join(meta, keys + ["algorithm"]).select(
            *keys,
            F.concat_ws(":", *keys, F.lit(version), "algorithm").alias("model_id"),
            "algorithm", F.lit(version).alias("version"), "file_path",
            F.lit("ready").alias("status"), "mae", "rmse", "mape", "r2",
            "hyperparameters", "is_active",
            F.lit(trained_at).cast("timestamp_ntz").alias("trained_at"),
            "kind", "implementation",
            F.when(F.col("pooled"), series_index(keys)).alias("series_index"),
        )
    else:
        registry = None
    return TrainingRun(version=version, registry=registry, errors=errors,
                       panel_path=panel_path, daily_path=daily_path, keys=keys,
                       models=results)


def series_index(keys: Sequence[str]) -> Column:
    """Per-dataset feature of a pooled model: a hash of the keys (exact as
    a double, no numbering job needed)."""
    return F.pmod(F.xxhash64(*keys), F.lit(2147483647)).cast("double")


def _fit_pooled(spark, panel, keys, ok, algorithm, tune, model_root, version):
    """One fit of ``algorithm`` over the training rows of every dataset that
    passed the guards; test predictions for all of them."""
    params = dict(DEFAULT_PARAMS[algorithm])
    path = os.path.join(model_root, "_pooled", f"{algorithm}_{version}")
    ok_df = spark.createDataFrame(ok, panel.select(*keys).schema)     # catalogue-sized
    rows = panel.join(ok_df, keys, "left_semi")
    train = rows.where(F.col("is_train")).select(*keys, "order_date", "features", "revenue").cache()
    try:
        if tune:
            model, params, impl = _tune(algorithm, train, keys)
        else:
            est, impl = make_estimator(algorithm, params)
            model = est.fit(train)
    finally:
        train.unpersist()
    model.write().overwrite().save(path)
    preds = model.transform(rows.where(~F.col("is_train"))).select(
        *keys, "order_date", "revenue", F.col("prediction").alias("prediction"),
        F.lit(algorithm).alias("algorithm"))
    return {"file_path": path, "kind": "tree", "implementation": impl + " (pooled)",
            "params": params, "test_predictions": preds, "model": model, "pooled": True}


def _fit_one(spark, panel, daily, keys, kv, algorithm, test_size, tune, model_root, version):
    params = dict(DEFAULT_PARAMS[algorithm])
    path = os.path.join(model_root, model_folder(kv), f"{algorithm}_{version}")
    if algorithm == "prophet":
        return _fit_additive(spark, daily, keys, kv, test_size, path, params)
    rows = panel.where(_key_filter(keys, kv))
    train = rows.where(F.col("is_train")).select(*keys, "order_date", "features", "revenue")
    test = rows.where(~F.col("is_train"))
    train = train.coalesce(1).cache()
    try:
        if tune:
            model, params, impl = _tune(algorithm, train, keys)
        else:
            est, impl = make_estimator(algorithm, params)
            model = est.fit(train)
    finally:
        train.unpersist()
    model.write().overwrite().save(path)
    preds = model.transform(test).select(
        *keys, "order_date", "revenue", F.col("prediction").alias("prediction"),
        F.lit(algorithm).alias("algorithm"))
    return {"file_path": path, "kind": "tree", "implementation": impl, "params": params,
            "test_predictions": preds, "model": model}


def _tune(algorithm, train, keys):
    """TRN7: random search over the grid with contiguous 3-fold CV on MAE."""
    draws = sample_param_maps(algorithm)
    base, impl = make_estimator(algorithm, DEFAULT_PARAMS[algorithm])
    grid = []
    for d in draws:
        p = dict(DEFAULT_PARAMS[algorithm], **d)
        est, _ = make_estimator(algorithm, p)
        grid.append({base.getParam(k): est.getOrDefault(k) for k in
                     ("maxIter", "maxDepth", "stepSize", "numTrees", "minInstancesPerNode")
                     if base.hasParam(k) and est.hasParam(k)})
    w = Window.partitionBy(*keys).orderBy("order_date")  # one dataset's train rows
    folded = train.withColumn("fold", (F.ntile(TUNE_FOLDS).over(w) - 1).cast("int"))
    cv = CrossValidator(estimator=base, estimatorParamMaps=grid,
                        evaluator=RegressionEvaluator(labelCol="revenue", metricName="mae"),
                        foldCol="fold", numFolds=TUNE_FOLDS, parallelism=TUNE_DRAWS, seed=SEED)
    cvm = cv.fit(folded)
    best = draws[int(min(range(len(cvm.avgMetrics)), key=lambda i: cvm.avgMetrics[i]))]
    return cvm.bestModel, dict(DEFAULT_PARAMS[algorithm], **best), impl + " tuned"


def _fit_additive(spark, daily, keys, kv, test_size, path, params):
    """TRN5: additive trend + seasonality model fit on the first
    ``int(n*(1-test_size))`` days (all days, no warm-up drop); the band is
    the 10 %/90 % residual quantiles on the training days."""
    d = daily.where(_key_filter(keys, kv))
    w = Window.partitionBy(*keys).orderBy("order_date")
    d = d.withColumn("_t", (F.row_number().over(w) - 1).cast("double"))
    n = d.count()
    split = int(n * (1 - test_size))
    cps = changepoints_for(split)
    names = additive_term_names(len(cps))
    design = d.select(*keys, "order_date", "revenue", "_t", *additive_terms("order_date", "_t", cps))
    design = VectorAssembler(inputCols=names, outputCol="features").transform(design)
    train = design.where(F.col("_t") < split).coalesce(1).cache()
    test = design.where(F.col("_t") >= split)
    try:
        lr = LinearRegression(labelCol="revenue", featuresCol="features", regParam=0.01,
                              elasticNetParam=0.0, standardization=True)
        model = lr.fit(train)
        resid = model.transform(train).select((F.col("revenue") - F.col("prediction")).alias("r"))
        q = resid.agg(F.percentile_approx("r", list(BAND_QUANTILES), 10000).alias("q")).first()["q"]
    finally:
        train.unpersist()
    model.write().overwrite().save(path)
    params = dict(params, changepoints=cps, n_train=split, n_days=n,
                  band=[float(q[0]), float(q[1])],
                  coefficients=[float(c) for c in model.coefficients.toArray()],
                  intercept=float(model.intercept))
    preds = model.transform(test).select(
        *keys, "order_date", "revenue", F.col("prediction").alias("prediction"),
        F.lit("prophet").alias("algorithm"))
    return {"file_path": path, "kind": "additive",
            "implementation": "additive Fourier + changepoints on mllib.LinearRegression",
            "params": params, "test_predictions": preds, "model": model}
