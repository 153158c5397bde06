"""Forecasting (FCT1-FCT7) and prediction records (SNK3).

Tree models forecast recursively: each step rebuilds the day's features
from history plus the model's own earlier predictions.  The recursion runs
as ``cogroup(...).applyInPandas``: per dataset, the last 30 daily values of
each of its series meet the model's node table (read by Spark straight from
the saved model, never through the driver) in one task, and the steps are
vectorised over that dataset's series with numpy.  A task therefore holds
30 rows per series plus one model — bounded however large the sales are.

The additive seasonal model forecasts directly: future days are generated
with ``sequence`` + ``explode`` and scored by the saved model's
``transform``.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import confidence_from_mape, round_half_up, segment_label
from tidemark.operators.training import additive_terms
from tidemark.schema import DEFAULT_HORIZON, LAGS, MAX_HORIZON, ROLL_WINDOWS, WARMUP_DAYS

HISTORY = WARMUP_DAYS  # the recursion never looks further back than 30 days


def check_horizon(horizon: int) -> int:
    """FCT7: 1..365 days."""
    if not isinstance(horizon, int) or not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon_days must be an integer in 1..{MAX_HORIZON}")
    return horizon


def segment_filter(sales: DataFrame, category: str | None = None, region: str | None = None
                   ) -> DataFrame:
    """FCT1: optional category / region equality filters (AND)."""
    if category:
        sales = sales.where(F.col("category") == category)
    if region:
        sales = sales.where(F.col("region") == region)
    return sales


def local_path(c: Column) -> Column:
    """File URI or path -> plain path (the key that ties series to models)."""
    return F.regexp_replace(c, "^file:/+", "/")


def tree_nodes(spark: SparkSession, models: DataFrame) -> DataFrame:
    """Node table of every distinct tree model in ``models`` (``file_path``,
    ``algorithm``), read from the saved MLlib models in one scan, keyed by
    ``_model`` (the model's folder) with tree weights.  A model shared by
    many datasets (pooled) appears once."""
    paths = [r["file_path"] for r in models.select("file_path").distinct().collect()]
    data = (spark.read.parquet(*[p + "/data" for p in paths])
            .withColumn("_model", F.regexp_extract(local_path(F.col("_metadata.file_path")),
                                                   r"^(.*)/data/[^/]+$", 1)))
    weights = (spark.read.parquet(*[p + "/treesMetadata" for p in paths])
               .withColumn("_model", F.regexp_extract(local_path(F.col("_metadata.file_path")),
                                                      r"^(.*)/treesMetadata/[^/]+$", 1))
               .select("_model", F.col("_1").alias("tree_id"), F.col("_3").alias("weight")))
    nodes = data.select(
        "_model", F.col("treeID").alias("tree_id"),
        F.col("nodeData.id").alias("node_id"),
        F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
    ).join(weights, ["_model", "tree_id"])
    kinds = models.select(local_path(F.col("file_path")).alias("_model"),
                          (F.col("algorithm") == "random_forest").alias("average")).distinct()
    return nodes.join(kinds, "_model")


def stored_nodes(spark: SparkSession, models: DataFrame) -> DataFrame:
    """Node rows, keyed by ``_model``, of the models of grouped training runs
    (``file_path``: the run's node table, ``model_id``).  A run is one path,
    however many models it holds."""
    paths = [r["file_path"] for r in models.select("file_path").distinct().collect()]
    wanted = models.select("model_id", (F.col("algorithm") == "random_forest").alias("average")).distinct()
    nodes = spark.read.parquet(*paths).where(F.col("error").isNull())
    return nodes.select("model_id", "tree_id", "node_id", "value", "left", "right", "feature", "threshold", "weight") \
        .join(wanted, "model_id").withColumnRenamed("model_id", "_model")


def compile_nodes(nodes: pd.DataFrame):
    """Flatten one model's trees into global-index arrays."""
    nodes = nodes.sort_values(["tree_id", "node_id"])
    sizes = nodes.groupby("tree_id", sort=True).size()
    offsets = np.concatenate([[0], np.cumsum(sizes.values)[:-1]])
    off = np.repeat(offsets, sizes.values)
    left = nodes["left"].to_numpy()
    right = nodes["right"].to_numpy()
    leaf = left < 0
    gl = np.where(leaf, -1, left + off)
    gr = np.where(leaf, -1, right + off)
    weights = nodes.drop_duplicates("tree_id").sort_values("tree_id")["weight"].to_numpy()
    return {
        "roots": offsets.astype(np.int64), "left": gl.astype(np.int64),
        "right": gr.astype(np.int64), "feature": nodes["feature"].fillna(0).to_numpy(np.int64),
        "threshold": nodes["threshold"].fillna(0.0).to_numpy(np.float64),
        "value": nodes["value"].to_numpy(np.float64), "leaf": leaf,
        "weights": weights.astype(np.float64), "average": bool(nodes["average"].iloc[0]),
    }


def predict_trees(model: dict, x: np.ndarray) -> np.ndarray:
    """Score rows ``x`` (S x F): go left when ``x[f] <= threshold``; sum of
    weighted leaves (boosting) or their mean (forest)."""
    idx = np.broadcast_to(model["roots"], (x.shape[0], model["roots"].size)).copy()
    rows = np.arange(x.shape[0])[:, None]
    while True:
        leaf = model["leaf"][idx]
        if leaf.all():
            break
        go_left = x[rows, model["feature"][idx]] <= model["threshold"][idx]
        nxt = np.where(go_left, model["left"][idx], model["right"][idx])
        idx = np.where(leaf, idx, nxt)
    vals = model["value"][idx]
    if model["average"]:
        return vals.mean(axis=1)
    return vals @ model["weights"]


def _calendar_row(day: dt.date) -> list[float]:
    iso = day.isocalendar()
    nxt = day + dt.timedelta(days=1)
    return [day.weekday(), day.day, day.month, (day.month - 1) // 3 + 1, day.year, iso[1],
            1.0 if day.weekday() >= 5 else 0.0, 1.0 if day.day == 1 else 0.0,
            1.0 if nxt.month != day.month else 0.0]


def _recursive_group(series_keys: list[str], horizon: int):
    def run(hist: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        cols = series_keys + ["step", "target_date", "predicted_revenue", "error"]
        if hist.empty:
            return pd.DataFrame(columns=cols)
        out, groups = [], []
        for key, g in hist.sort_values("order_date").groupby(series_keys, sort=False, dropna=False):
            why = ("the model has no stored nodes" if nodes.empty else
                   f"fewer than {HISTORY} days of history" if g["n_days"].iloc[0] < HISTORY else None)
            if why is None:
                groups.append((key, g))
            else:
                out.append((*(key if isinstance(key, tuple) else (key,)), None, None, None, why))
        if not groups:
            return pd.DataFrame(out, columns=cols)
        model = compile_nodes(nodes)
        s = len(groups)
        buf = np.zeros((s, HISTORY + horizon))
        n_days = np.zeros(s, dtype=np.int64)
        last, extra = [], []
        for i, (_, g) in enumerate(groups):
            vals = g["revenue"].to_numpy(np.float64)
            buf[i, HISTORY - len(vals):HISTORY] = vals
            n_days[i] = int(g["n_days"].iloc[0])
            last.append(pd.Timestamp(g["last_date"].iloc[0]).date())
            e = g["_extra"].iloc[0]
            extra.append([] if e is None else list(e))
        extra = np.asarray(extra, dtype=np.float64).reshape(s, -1)
        for h in range(1, horizon + 1):
            pos = HISTORY + h - 1                       # column being predicted
            rows = []
            for i in range(s):
                rows.append(_calendar_row(last[i] + dt.timedelta(days=h)))
            x = np.asarray(rows, dtype=np.float64)
            lags = np.stack([buf[:, pos - k] for k in LAGS], axis=1)
            rolls = []
            for w in ROLL_WINDOWS:
                win = buf[:, pos - w:pos]
                rolls += [win.mean(axis=1), win.std(axis=1, ddof=1)]
            t = (n_days - 1 + h).astype(np.float64)[:, None]
            x = np.hstack([x, lags, np.stack(rolls, axis=1), t, extra])
            y = np.maximum(predict_trees(model, x), 0.0)
            buf[:, pos] = y
            for i, (key, _) in enumerate(groups):
                key = key if isinstance(key, tuple) else (key,)
                out.append((*key, h, last[i] + dt.timedelta(days=h), float(y[i]), None))
        return pd.DataFrame(out, columns=cols)
    return run


def recursive_forecast(daily: DataFrame, nodes: DataFrame, series_keys: Sequence[str],
                       horizon: int = DEFAULT_HORIZON, salt: int = 1) -> DataFrame:
    """FCT2: ``horizon`` days per series, each step fed the previous
    predictions (clipped at 0); a series with too short a history, or whose
    model has no nodes, gives one row with ``error`` and nothing else.

    ``daily`` is gap-free per series and carries ``_model`` (the series'
    model folder) and ``_extra`` (features appended after the fixed 22, e.g.
    the dataset index of a pooled model); ``nodes`` comes from
    ``tree_nodes``.  Series and nodes meet by ``cogroup`` on the model; with
    ``salt`` > 1 a model's series are spread over ``salt`` hash buckets and
    its nodes replicated once per bucket (an ``explode``, not a join), so a
    model serving many series runs in several tasks."""
    check_horizon(horizon)
    series_keys = list(series_keys)
    w = Window.partitionBy(*series_keys).orderBy(F.col("order_date").desc())
    whole = Window.partitionBy(*series_keys)
    hist = (daily.select(*series_keys, "_model", "_extra", "order_date", "revenue",
                         F.row_number().over(w).alias("_back"),
                         F.count(F.lit(1)).over(whole).alias("n_days"),
                         F.max("order_date").over(whole).alias("last_date"))
            .where(F.col("_back") <= HISTORY).drop("_back"))
    hist = hist.withColumn("_salt", F.pmod(F.xxhash64(*series_keys), F.lit(max(salt, 1))))
    nodes = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                            F.lit(max(salt, 1) - 1).cast("bigint"))))
    schema_fields = ", ".join(f"`{k}` {hist.schema[k].dataType.simpleString()}"
                              for k in series_keys)
    schema = f"{schema_fields}, step int, target_date date, predicted_revenue double, error string"
    fn = _recursive_group(series_keys, horizon)
    return (hist.groupBy("_model", "_salt")
            .cogroup(nodes.groupBy("_model", "_salt"))
            .applyInPandas(fn, schema=schema))


def tree_band(forecast: DataFrame, models: DataFrame, series_keys: Sequence[str],
              model_keys: Sequence[str]) -> DataFrame:
    """FCT3 + EVL4: band ``rmse * sqrt(step)``; without a usable RMSE the
    sample std of the series' predictions, else 1.0; lower bound clipped at
    0; confidence from the model's MAPE."""
    series_keys = list(series_keys)
    f = forecast.join(models.select(*model_keys, "rmse", "mape"),
                      list(model_keys), "left")                 # one row per model
    sd = F.stddev_samp("predicted_revenue").over(Window.partitionBy(*series_keys))
    f = f.withColumn("_sd", sd)
    usable_sd = F.when(F.col("_sd").isNotNull() & ~F.isnan("_sd") & (F.col("_sd") != 0),
                       F.col("_sd")).otherwise(F.lit(1.0))
    scale = F.when(F.col("rmse").isNotNull() & (F.col("rmse") != 0), F.col("rmse")).otherwise(
        usable_sd)
    band = scale * F.sqrt(F.col("step").cast("double"))
    return f.select(
        *series_keys, "step", "target_date", "predicted_revenue",
        F.greatest(F.col("predicted_revenue") - band, F.lit(0.0)).alias("lower_bound"),
        (F.col("predicted_revenue") + band).alias("upper_bound"),
        confidence_from_mape("mape").alias("confidence_score"),
        *(["error"] if "error" in forecast.columns else []),
    )


ADDITIVE_PARAMS = ("struct<changepoints: array<double>, band: array<double>, "
                   "coefficients: array<double>, intercept: double>")


def additive_score(date_col: str) -> Column:
    """The additive model's value for ``_t`` (days since the series began)
    and ``date_col`` under the parameters ``_p``: hinge terms come from
    ``transform`` over the changepoints, the sum is a ``zip_with`` dot
    product - the design columns of the fit, in their order."""
    seasonal = additive_terms(date_col, "_t", [])[1:]
    terms = F.concat(F.array(F.col("_t")),
                     F.transform("_p.changepoints", lambda c: F.greatest(F.col("_t") - c, F.lit(0.0))),
                     F.array(*seasonal))
    dot = F.aggregate(F.zip_with("_p.coefficients", terms, lambda a, b: a * b),
                      F.lit(0.0), lambda acc, x: acc + x)
    return F.col("_p.intercept") + dot


def additive_forecast(daily: DataFrame, models: DataFrame, series_keys: Sequence[str],
                      model_keys: Sequence[str], horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """FCT4: direct forecast of the additive model for the ``horizon`` days
    after each series' last day; value and 10/90 % band clipped at 0.

    Every dataset is scored in one job: its model's changepoints and
    coefficients (a few dozen numbers, kept with the registry row) are
    joined to its series, hinge terms come from ``transform`` over the
    changepoints and the prediction is a ``zip_with`` dot product — the same
    design columns, in the same order, as the fit."""
    check_horizon(horizon)
    series_keys, model_keys = list(series_keys), list(model_keys)
    m = models.select(*model_keys, F.from_json("hyperparameters", ADDITIVE_PARAMS).alias("_p"),
                      F.col("mape").alias("_mape"))
    bounds = daily.groupBy(*series_keys).agg(F.max("order_date").alias("_last"),
                                            F.count(F.lit(1)).alias("_n"))
    fut = bounds.join(m, model_keys).select(      # one row per model
        *series_keys, "_n", "_p", "_mape",
        F.posexplode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon)))
        .alias("_i", "target_date"))
    t = (F.col("_n") + F.col("_i")).cast("double")
    scored = fut.withColumn("_t", t).withColumn("_yhat", additive_score("target_date"))
    yhat = F.col("_yhat")
    return scored.select(
        *series_keys, (F.col("_i") + 1).cast("int").alias("step"), "target_date",
        F.greatest(yhat, F.lit(0.0)).alias("predicted_revenue"),
        F.greatest(yhat + F.col("_p.band")[0], F.lit(0.0)).alias("lower_bound"),
        F.greatest(yhat + F.col("_p.band")[1], F.lit(0.0)).alias("upper_bound"),
        confidence_from_mape("_mape").alias("confidence_score"),
    )


def response_points(forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FCT6: values rounded to 2 places, bounds defaulting to the value,
    confidence defaulting to 0.5."""
    p = F.col("predicted_revenue")
    cols = forecast.columns
    lower = F.col("lower_bound") if "lower_bound" in cols else p
    upper = F.col("upper_bound") if "upper_bound" in cols else p
    conf = F.col("confidence_score") if "confidence_score" in cols else F.lit(0.5)
    return forecast.select(
        *keys, "step", F.col("target_date").alias("date"),
        round_half_up(p, 2).alias("predicted_revenue"),
        round_half_up(F.coalesce(lower, p), 2).alias("lower_bound"),
        round_half_up(F.coalesce(upper, p), 2).alias("upper_bound"),
        F.coalesce(conf, F.lit(0.5)).alias("confidence_score"),
        *(["error"] if "error" in cols else []),
    )


def prediction_records(forecast: DataFrame, model_id: Column | str,
                       category: str | None = None, region: str | None = None,
                       created_at: dt.datetime | None = None) -> DataFrame:
    """SNK3: one unrounded prediction row per day with its segment label."""
    mid = F.col(model_id) if isinstance(model_id, str) else model_id
    created = created_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    p = F.col("predicted_revenue")
    if "error" in forecast.columns:
        forecast = forecast.where(F.col("error").isNull())
    return forecast.select(
        mid.alias("model_id"), "target_date", "predicted_revenue",
        F.coalesce(F.col("lower_bound"), p).alias("lower_bound"),
        F.coalesce(F.col("upper_bound"), p).alias("upper_bound"),
        F.coalesce(F.col("confidence_score"), F.lit(0.5)).alias("confidence_score"),
        segment_label(F.lit(category), F.lit(region)).alias("segment"),
        F.lit(created).cast("timestamp_ntz").alias("created_at"),
    )
