"""Training, tuning and comparison of all datasets in a fixed number of jobs.

A model belongs to one dataset, and its panel is one row a day, so the unit
of work is a fit: (dataset, algorithm), or (dataset, algorithm, draw, fold)
while tuning.  Spark builds the panels, deals the fits to tasks by grouping
on those keys, scores held-out days by a cogroup of rows and nodes, and
evaluates and compares all models in one aggregate.  There is no loop over
datasets, nothing of a dataset passes through the driver - not its key, its
counts, its parameters or its model's path - and the number of jobs does not
depend on the number of datasets.

Models are rows: every tree node of a run stands in one Parquet table keyed by
``model_id``, and the additive model's coefficients are in its registry row.

A dataset that the guards refuse, and a fit that fails, become rows of
``errors``; the others go on.
"""

from __future__ import annotations

import datetime as dt
import itertools
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import additive_fit, tree_fit
from tidemark.operators import aggregates as agg
from tidemark.operators import features as fe
from tidemark.operators.forecast import ADDITIVE_PARAMS, additive_score, compile_nodes, predict_trees
from tidemark.operators.metrics import evaluate
from tidemark.operators.selection import new_version, pick_best
from tidemark.operators.training import (BAND_QUANTILES, DEFAULT_PARAMS, SEED, TUNE_FOLDS, WEEKLY_ORDER, YEARLY_ORDER,
                                         TrainingRun, changepoints_for, sample_param_maps)
from tidemark.schema import AVAILABLE_ALGORITHMS, FEATURE_COLS, MIN_FEATURE_ROWS, MIN_SALES_ROWS
from tidemark.session import write_once, written

ADDITIVE = "prophet"
PARTS_PER_CORE = 8
PERIODS = [(7.0, WEEKLY_ORDER), (365.25, YEARLY_ORDER)]

# FIXED VALUES - library defaults beside the request's parameters: leaf weight
# penalty and histogram bins of one library, rows of a leaf and bins of the other.
XGBOOST_L2, XGBOOST_BINS = 1.0, 256
LIGHTGBM_MIN_LEAF, LIGHTGBM_BINS = 20, 255

IMPLEMENTATION = {
    "gradient_boosting": "exact depth-wise boosting by dataset",
    "random_forest": "bootstrapped exact trees by dataset",
    "xgboost": "second-order depth-wise boosting by dataset",
    "lightgbm": "second-order leaf-wise boosting by dataset",
    ADDITIVE: "additive Fourier + L1 changepoints from Gram matrices",
}

NODES = T.StructType([T.StructField(c, T.IntegerType() if c in ("tree_id", "node_id", "left", "right", "feature") else T.DoubleType())
                      for c in tree_fit.NODE_COLUMNS] + [T.StructField("error", T.StringType())])


def spec_of(algorithm: str, params: dict) -> dict:
    """What ``tree_fit`` is asked for."""
    spec = {"n_estimators": params["n_estimators"], "max_depth": params.get("max_depth"), "rate": params.get("learning_rate")}
    if algorithm == "random_forest":
        spec["min_leaf"] = params.get("min_samples_leaf", 1)
    elif algorithm == "xgboost":
        spec |= {"l2": XGBOOST_L2, "max_bins": XGBOOST_BINS, "subsample": params.get("subsample", 1.0), "colsample": params.get("colsample_bytree", 1.0)}
    elif algorithm == "lightgbm":
        spec |= {"num_leaves": params["num_leaves"], "min_leaf": LIGHTGBM_MIN_LEAF, "max_bins": LIGHTGBM_BINS}
    return spec


def draws_of(algorithm: str) -> list[dict]:
    """TRN7: the points of the search, over the library's own defaults."""
    return sample_param_maps(algorithm)


def _configs(spark: SparkSession, algorithms: Sequence[str], tune: bool) -> Column:
    """Array of (algorithm, draw, params): a few dozen entries."""
    rows = []
    for a in algorithms:
        for i, params in enumerate(draws_of(a) if tune else [DEFAULT_PARAMS[a]]):
            rows.append(F.struct(F.lit(a).alias("algorithm"), F.lit(i).alias("draw"), F.lit(json.dumps(params)).alias("params")))
    return F.array(*rows)


def _dealt(fits: DataFrame, *by: str) -> DataFrame:
    """One group after another is little data but much work: dealt to a fixed
    number of partitions, which are not merged for being small."""
    sc = fits.sparkSession.sparkContext
    return fits.repartition(max(PARTS_PER_CORE * sc.defaultParallelism, int(fits.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


# ---- inside a group ----------------------------------------------------------

def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values("order_date", kind="stable")
    return np.stack(rows["x"].to_numpy()).astype(float), rows["revenue"].to_numpy(float)


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    spec = spec_of(rows["algorithm"].iloc[0], json.loads(rows["params"].iloc[0]))
    return tree_fit.fit_ensemble(*_arrays(rows), spec, SEED)


def _failed(key: Sequence, algorithm: str, exc: Exception) -> str:
    return f"Fit of '{algorithm}' failed: {exc}"


def _fit_group(keys: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = _fitted(rows).assign(error=None)
        except Exception as exc:  # noqa: BLE001  (TRN6: a failing fit is recorded)
            out = pd.DataFrame([{c: None for c in tree_fit.NODE_COLUMNS} | {"error": _failed(keys, rows["algorithm"].iloc[0], exc)}])
        return out.assign(**{k: rows[k].iloc[0] for k in keys}, algorithm=rows["algorithm"].iloc[0])[
            [*keys, "algorithm", *NODES.names]]
    return run


def _fold_group(keys: list[str]):
    """One fit of the search: trained without its fold, judged on it."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        held = (rows["row_fold"] == rows["fold"]).to_numpy()
        mae, error = None, None
        try:
            nodes = _fitted(rows[~held]).assign(average=first["algorithm"] == "random_forest")
            x, y = _arrays(rows[held])
            mae = float(np.abs(predict_trees(compile_nodes(nodes), x) - y).mean())
        except Exception as exc:  # noqa: BLE001
            error = _failed(keys, first["algorithm"], exc)
        return pd.DataFrame([{**{k: first[k] for k in keys}, **{c: first[c] for c in ("algorithm", "draw", "params", "fold")},
                              "mae": mae, "error": error}])
    return run


def _score_group(keys: list[str]):
    def run(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "algorithm", "order_date", "revenue", "prediction"]
        if rows.empty or nodes.empty:
            return pd.DataFrame(columns=columns)
        nodes = nodes.assign(average=nodes["algorithm"].iloc[0] == "random_forest")
        return rows.assign(prediction=predict_trees(compile_nodes(nodes), np.stack(rows["x"].to_numpy()).astype(float)))[columns]
    return run


def _additive_group(keys: list[str], test_size: float):
    def run(days: pd.DataFrame) -> pd.DataFrame:
        first, algorithm = days.iloc[0], ADDITIVE
        row = {**{k: first[k] for k in keys}, "algorithm": algorithm, "params": None, "error": None}
        try:
            days = days.sort_values("order_date")
            n = len(days)
            split = int(n * (1 - test_size))
            day = (pd.to_datetime(days["order_date"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)[:split]
            y, t, cps = days["revenue"].to_numpy(float)[:split], np.arange(split, dtype=float), changepoints_for(split)
            x = additive_fit.design(day, t, cps, PERIODS)
            coefficients, intercept = additive_fit.fit(x, y, len(cps))
            rest = y - x @ coefficients - intercept
            row["params"] = json.dumps(dict(DEFAULT_PARAMS[algorithm], changepoints=cps, n_train=split, n_days=n,
                                            band=np.quantile(rest, BAND_QUANTILES).tolist(),
                                            coefficients=coefficients.tolist(), intercept=intercept))
        except Exception as exc:  # noqa: BLE001
            row["error"] = _failed(keys, algorithm, exc)
        return pd.DataFrame([row])
    return run


# ---- the run -------------------------------------------------------------------

def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def _guards(daily: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """TRN8: keys with ``error`` set where there is too little data."""
    sales = daily.groupBy(*keys).agg(F.sum("n_rows").alias("n_sales"))
    feats = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"))
    return sales.join(feats, keys, "left").select(
        *keys, F.when(F.col("n_sales") < MIN_SALES_ROWS, F.lit("Not enough historical data to train a model."))
        .when(F.coalesce("n_features", F.lit(0)) < MIN_FEATURE_ROWS, F.lit("Not enough usable rows after feature engineering.")).alias("error"))


def tuned(train: DataFrame, keys: Sequence[str], algorithms: Sequence[str]) -> DataFrame:
    """TRN7 for every dataset and algorithm at once: keys, algorithm, params
    (those of the draw with the smallest mean MAE over contiguous folds),
    cv_mae and error.  A draw with a failing fold is out."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("order_date")          # one dataset's days
    folds = F.array(*[F.lit(i) for i in range(TUNE_FOLDS)])
    fits = (train.withColumn("row_fold", F.ntile(TUNE_FOLDS).over(w) - 1)
            .withColumn("config", F.explode(_configs(train.sparkSession, algorithms, True)))
            .select(*keys, "order_date", "revenue", "x", "row_fold", "config.*", F.explode(folds).alias("fold")))
    schema = T.StructType([*_key_fields(train, keys), T.StructField("algorithm", T.StringType()), T.StructField("draw", T.IntegerType()),
                           T.StructField("params", T.StringType()), T.StructField("fold", T.IntegerType()),
                           T.StructField("mae", T.DoubleType()), T.StructField("error", T.StringType())])
    judged = _dealt(fits, *keys, "algorithm", "draw", "fold").groupBy(*keys, "algorithm", "draw", "fold").applyInPandas(_fold_group(keys), schema)
    draws = judged.groupBy(*keys, "algorithm", "draw").agg(
        F.when(F.count("mae") == TUNE_FOLDS, F.avg("mae")).alias("mae"), F.max("params").alias("params"), F.max("error").alias("error"))
    best = draws.groupBy(*keys, "algorithm").agg(
        F.min(F.when(F.col("mae").isNotNull(), F.struct("mae", "draw", "params"))).alias("best"), F.max("error").alias("error"))
    return best.select(*keys, "algorithm", "best.params", F.col("best.mae").alias("cv_mae"),
                       F.when(F.col("best").isNull(), F.col("error")).alias("error"))


def fit_nodes(train: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Node rows of one ensemble for each row of ``chosen`` (keys, algorithm,
    params): one job, a group a fit."""
    keys = list(keys)
    schema = T.StructType([*_key_fields(train, keys), T.StructField("algorithm", T.StringType()), *NODES.fields])
    rows = train.select(*keys, "order_date", "revenue", "x").join(chosen.select(*keys, "algorithm", "params"), keys)
    return _dealt(rows, *keys, "algorithm").groupBy(*keys, "algorithm").applyInPandas(_fit_group(keys), schema)


def additive_models(daily: DataFrame, keys: Sequence[str], test_size: float) -> DataFrame:
    """TRN5 for every dataset in one job: keys, algorithm, params, error."""
    keys = list(keys)
    schema = T.StructType([*_key_fields(daily, keys), *[T.StructField(c, T.StringType()) for c in ("algorithm", "params", "error")]])
    return _dealt(daily.select(*keys, "order_date", "revenue"), *keys).groupBy(*keys).applyInPandas(_additive_group(keys, test_size), schema)


def _additive_predictions(daily: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """The days after each model's training days, by its coefficients."""
    w = Window.partitionBy(*keys).orderBy("order_date")          # one dataset's days
    days = daily.select(*keys, "order_date", "revenue", (F.row_number().over(w) - 1).cast("double").alias("_t"))
    p = models.select(*keys, "algorithm", F.from_json("params", ADDITIVE_PARAMS).alias("_p"),
                      F.get_json_object("params", "$.n_train").cast("double").alias("_split"))
    days = days.join(p, keys).where(F.col("_t") >= F.col("_split"))
    return days.select(*keys, "algorithm", "order_date", "revenue", additive_score("order_date").alias("prediction"))


def train_grouped(sales: DataFrame, keys: Sequence[str] = ("dataset_id",), algorithms: Sequence[str] = AVAILABLE_ALGORITHMS,
                  test_size: float = 0.2, tune: bool = False, version: str | None = None,
                  trained_at: dt.datetime | None = None, model_root: str | None = None) -> TrainingRun:
    """TRN6/TRN9: every requested algorithm for every dataset, judged on the
    chronological test split, the best of each dataset flagged.  Unknown
    algorithms are skipped; refusals and failing fits are in ``errors``.  The
    run's node table is a folder of ``model_root`` (the shared folder, if
    none is named)."""
    if not 0.0 < test_size < 0.5:
        raise ValueError("test_size must be in (0, 0.5)")
    keys, version = list(keys), version or new_version()
    trained_at = trained_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark = sales.sparkSession
    wanted = [a for a in dict.fromkeys(algorithms) if a in AVAILABLE_ALGORITHMS]
    trees = [a for a in wanted if a != ADDITIVE]

    daily = write_once(agg.daily_revenue(sales, keys, with_counts=True), "training-daily")
    feats = fe.chrono_split(fe.build_features(daily, keys), keys, test_size)
    panel = write_once(feats.select(*keys, "order_date", "revenue", F.array(*[F.col(c).cast("double") for c in FEATURE_COLS]).alias("x"), "is_train"),
                       "training-panel")
    guards = write_once(_guards(daily, panel, keys), "training-guards")
    ready = guards.where(F.col("error").isNull()).select(*keys)
    errors = [guards.where(F.col("error").isNotNull()).select(*keys, "error")]
    train = panel.where("is_train").join(ready, keys, "left_semi")
    models, predictions = [], []

    if trees:
        if tune:
            chosen = write_once(tuned(train, keys, trees), "training-tuned")
            errors.append(chosen.where(F.col("error").isNotNull()).select(*keys, "error"))
            chosen = chosen.where(F.col("error").isNull()).select(*keys, "algorithm", "params")
        else:
            chosen = ready.withColumn("config", F.explode(_configs(spark, trees, False))).select(*keys, "config.algorithm", "config.params")
        fitted = fit_nodes(train, chosen, keys).withColumn("model_id", model_id(keys, version))
        nodes_path, nodes = written(fitted, "training-nodes", model_root)
        failed = nodes.where(F.col("error").isNotNull())
        errors.append(failed.select(*keys, "error"))
        models.append(chosen.join(failed.select(*keys, "algorithm"), [*keys, "algorithm"], "left_anti")
                      .select(*keys, "algorithm", "params", F.lit("nodes").alias("kind"), F.lit(nodes_path).alias("file_path")))
        held = panel.where("not is_train").join(chosen.select(*keys, "algorithm"), keys)
        scored = T.StructType([*_key_fields(panel, keys), T.StructField("algorithm", T.StringType()), panel.schema["order_date"],
                               panel.schema["revenue"], T.StructField("prediction", T.DoubleType())])
        by = [*keys, "algorithm"]
        predictions.append(held.groupBy(*by).cogroup(nodes.where(F.col("error").isNull()).groupBy(*by)).applyInPandas(_score_group(keys), scored))
    if ADDITIVE in wanted:
        fits = write_once(additive_models(daily.join(ready, keys, "left_semi"), keys, test_size), "training-additive")
        errors.append(fits.where(F.col("error").isNotNull()).select(*keys, "error"))
        fits = fits.where(F.col("error").isNull())
        models.append(fits.select(*keys, "algorithm", "params", F.lit("additive").alias("kind"), F.lit("").alias("file_path")))
        predictions.append(_additive_predictions(daily, fits, keys))

    errors = write_once(_union(errors), "training-errors")
    if not models:
        return TrainingRun(version, None, errors, "", "", keys)
    metrics = pick_best(evaluate(_union(predictions), keys + ["algorithm"]), keys, list(algorithms))
    label = F.create_map(*itertools.chain(*[(F.lit(a), F.lit(IMPLEMENTATION[a] + (" tuned" if tune and a != ADDITIVE else ""))) for a in wanted]))
    registry = metrics.join(_union(models), keys + ["algorithm"]).select(
        *keys, model_id(keys, version).alias("model_id"), "algorithm", F.lit(version).alias("version"), "file_path",
        F.lit("ready").alias("status"), "mae", "rmse", "mape", "r2", F.col("params").alias("hyperparameters"), "is_active",
        F.lit(trained_at).cast("timestamp_ntz").alias("trained_at"), "kind", label[F.col("algorithm")].alias("implementation"),
        F.lit(None).cast("double").alias("series_index"))
    return TrainingRun(version, write_once(registry, "training-registry"), errors, "", "", keys)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_id(keys: Sequence[str], version: str) -> Column:
    return F.concat_ws(":", *keys, F.lit(version), "algorithm")
