"""Seasonal-naive baselines and the registry runs built from them.

A seasonal-naive model predicts a day with the value ``k`` days earlier
(``naive_lag_k``).  It needs no fitting, so its metrics, model choice and
forecast bands can be checked value-for-value against SQL, and it gives
the learned models a floor to beat (their R² is often negative).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators.metrics import evaluate
from tidemark.operators.selection import pick_best
from tidemark.session import materialize

NAIVE_LAGS = (1, 7, 14)
NAIVE_ALGORITHMS = [f"naive_lag_{k}" for k in NAIVE_LAGS]
# Two runs (test sizes) per dataset give each dataset two registry versions.
RUNS = ((1, 0.2), (2, 0.3))


def naive_predictions(features: DataFrame, keys: Sequence[str], test_size: float,
                      lags: Sequence[int] = NAIVE_LAGS) -> DataFrame:
    """Test-split rows x algorithms with ``prediction`` = lagged revenue."""
    keys = list(keys)
    test = fe.chrono_split(features, keys, test_size).where(~F.col("is_train"))
    pairs = F.array(*[F.struct(F.lit(f"naive_lag_{k}").alias("algorithm"),
                               F.col(f"revenue_lag_{k}").alias("prediction")) for k in lags])
    return test.select(*keys, "order_date", "revenue", F.inline(pairs))


def naive_run_metrics(features: DataFrame, keys: Sequence[str], test_size: float) -> DataFrame:
    keys = list(keys)
    return evaluate(naive_predictions(features, keys, test_size), keys + ["algorithm"])


def naive_registry(features: DataFrame, keys: Sequence[str] = ("dataset_id",),
                   runs: Sequence[tuple[int, float]] = RUNS) -> DataFrame:
    """Registry rows for every run: metrics, version, run time, JSON
    hyperparameters and the run's active (best) model."""
    keys = list(keys)
    features = materialize(features)
    last_day = features.groupBy(*keys).agg(F.max("order_date").alias("_last"))
    out = None
    for run, ts in runs:
        m = pick_best(naive_run_metrics(features, keys, ts), keys, NAIVE_ALGORITHMS)
        m = m.join(last_day, keys).withColumn(
            "trained_at", F.timestamp_add("HOUR", F.lit(run), F.col("_last").cast("timestamp_ntz")))
        out = m if out is None else out.unionByName(m)
    lag = F.regexp_extract("algorithm", r"(\d+)$", 1).cast("int")
    version = F.concat(F.date_format("trained_at", "yyyyMMddHHmmss"), F.lit("_"),
                       F.substring(F.md5(F.concat_ws("|", *keys)), 1, 6))
    return out.select(
        *keys,
        F.concat_ws(":", *keys, version, "algorithm").alias("model_id"),
        "algorithm", version.alias("version"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit("ready").alias("status"),
        "mae", "rmse", "mape", "r2",
        F.to_json(F.struct(lag.alias("lag"))).alias("hyperparameters"),
        "is_active", "trained_at",
    )


def naive_forecast(daily: DataFrame, keys: Sequence[str], lag: int, horizon: int) -> DataFrame:
    """Seasonal-naive forecast: day ``last + h`` repeats the value ``lag``
    days before it, i.e. the last ``lag`` days cycle forward (direct, no
    fitting).  One generated row per (series, step) joined back to the
    series' own history."""
    keys = list(keys)
    last = daily.groupBy(*keys).agg(F.max("order_date").alias("_last"))
    steps = last.select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    back = F.col("step") - F.lit(lag) * F.ceil(F.col("step") / F.lit(lag))
    src = steps.select(*keys, "step", F.date_add("_last", 1).alias("_first"),
                       F.date_add("_last", back.cast("int")).alias("_src"))
    return src.join(daily.select(*keys, F.col("order_date").alias("_src"), "revenue"),
                    keys + ["_src"], "left").select(
        *keys, F.col("step").cast("int").alias("step"),
        F.date_add("_first", F.col("step") - 1).alias("target_date"),
        F.coalesce("revenue", F.lit(0.0)).alias("predicted_revenue"))
