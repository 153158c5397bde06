"""Regression metrics per group (EVL1-EVL4).

``evaluate`` is a grouped aggregate: one row per (keys) with MAE, RMSE,
MAPE and R².  R² uses the two-pass form (mean first, then squared
deviations) so constant targets give exactly SStot = 0 -> null.  The mean
comes from a window over the group — a group is the test rows of one
series and model, bounded by its calendar span — so the input is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import confidence_from_mape


def evaluate(pred: DataFrame, keys: Sequence[str], label: str = "revenue",
             prediction: str = "prediction") -> DataFrame:
    """EVL1-3: mae, rmse, mape (over rows with y != 0, x100; null if none),
    r2 (null when SStot = 0)."""
    keys = list(keys)
    y, yhat = F.col(label), F.col(prediction)
    err = y - yhat
    dev = y - F.col("_mean_y")
    g = pred.withColumn("_mean_y", F.avg(label).over(Window.partitionBy(*keys))).groupBy(
        *keys).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(y != 0, F.abs(err / y))) * 100).alias("mape"),
        F.sum(err * err).alias("_ss_res"),
        F.sum(dev * dev).alias("_ss_tot"),
    )
    return g.select(
        *keys, "mae", "rmse", "mape",
        F.when(F.col("_ss_tot") > 0, 1 - F.col("_ss_res") / F.col("_ss_tot")).alias("r2"),
    )


def with_confidence(metrics: DataFrame, mape: str = "mape") -> DataFrame:
    """EVL4: confidence score from MAPE."""
    return metrics.withColumn("confidence_score", confidence_from_mape(mape))
