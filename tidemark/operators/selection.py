"""Model selection and the append-only model registry (MOD1-MOD5, SNK4).

The registry is an append-only table: a training run appends one row per
algorithm with ``is_active`` set on its best model.  Which model is active
*now* is derived (the flagged model of the dataset's latest run), so no row
is ever updated in place.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import AVAILABLE_ALGORITHMS

DEFAULT_KEYS = ("dataset_id",)


def list_algorithms() -> list[str]:
    """MOD5."""
    return list(AVAILABLE_ALGORITHMS)


def new_version(now: dt.datetime | None = None) -> str:
    """MOD4: ``yyyyMMddHHmmss_`` + 6 hex digits, shared by one run."""
    now = now or dt.datetime.now(dt.timezone.utc)
    return now.strftime("%Y%m%d%H%M%S") + "_" + uuid.uuid4().hex[:6]


def algorithm_order(algorithms: Sequence[str], col: str = "algorithm") -> Column:
    """Position of each algorithm in the request (ties keep request order)."""
    expr = F.lit(len(algorithms))
    for i, a in reversed(list(enumerate(algorithms))):
        expr = F.when(F.col(col) == a, F.lit(i)).otherwise(expr)
    return expr


def pick_best(metrics: DataFrame, keys: Sequence[str], algorithms: Sequence[str]) -> DataFrame:
    """MOD1: flag the lowest-MAE model per key; null MAE never wins; ties
    keep request order.  A key holds one row per algorithm, so the window is
    a handful of rows."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("mae").asc_nulls_last(),
                                          algorithm_order(algorithms))
    return metrics.withColumn("is_active", (F.row_number().over(w) == 1)
                              & F.col("mae").isNotNull())


def compare_models(registry: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """MOD2: all models of each dataset, newest first."""
    return registry.orderBy(*keys, F.col("trained_at").desc(), F.col("model_id"))


def current_active(registry: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Active flag as of now: flagged in the dataset's latest run."""
    keys = list(keys)
    latest = registry.groupBy(*keys).agg(F.max("trained_at").alias("_latest"))
    return registry.join(latest, keys).withColumn(
        "is_active", F.col("is_active") & (F.col("trained_at") == F.col("_latest"))
    ).drop("_latest")


def resolve_model(registry: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                  algorithm: str | None = None, require_ready: bool = True) -> DataFrame:
    """MOD3: per dataset, the latest READY model of ``algorithm`` or, when
    none is named, the latest active one.  Datasets with no match are
    absent (the caller reports "no trained model").  A max over a
    (trained_at, model_id) struct is a partial aggregate, not a window."""
    keys = list(keys)
    r = current_active(registry, keys)
    if require_ready:
        r = r.where(F.col("status") == "ready")
    r = r.where(F.col("algorithm") == algorithm) if algorithm else r.where(F.col("is_active"))
    other = [c for c in r.columns if c not in keys]
    best = F.max(F.struct(F.col("trained_at").alias("_t"), F.col("model_id").alias("_id"),
                          *[F.col(c) for c in other]))
    return r.groupBy(*keys).agg(best.alias("_m")).select(
        *keys, *[F.col("_m").getField(c).alias(c) for c in other])
