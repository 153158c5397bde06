"""Feature engineering over gap-free daily series (DT1, WIN1-7, FEA1).

Windows are always partitioned by the series keys and ordered by day, so a
window partition holds one series' days (bounded by its calendar span, not
by the volume of sales behind it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_features
from tidemark.schema import FEATURE_COLS, LAGS, ROLL_WINDOWS

DEFAULT_KEYS = ("dataset_id",)


def series_window(keys: Sequence[str], date_col: str = "order_date") -> Window:
    return Window.partitionBy(*keys).orderBy(date_col)


def lag_features(keys: Sequence[str], value: str = "revenue", lags: Sequence[int] = LAGS,
                 date_col: str = "order_date") -> list[Column]:
    """WIN1: value ``n`` days back (null for the first ``n`` days)."""
    w = series_window(keys, date_col)
    return [F.lag(value, n).over(w).alias(f"{value}_lag_{n}") for n in lags]


def rolling_features(keys: Sequence[str], value: str = "revenue",
                     windows: Sequence[int] = ROLL_WINDOWS, date_col: str = "order_date"
                     ) -> list[Column]:
    """WIN2-4: mean and sample std of the ``n`` days before today, null
    until ``n`` such days exist (full-window rule)."""
    w = series_window(keys, date_col)
    rn = F.row_number().over(w)
    out = []
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        full = rn > n
        out.append(F.when(full, F.avg(value).over(frame)).alias(f"{value}_roll_mean_{n}"))
        out.append(F.when(full, F.stddev_samp(value).over(frame))
                   .alias(f"{value}_roll_std_{n}"))
    return out


def time_index(keys: Sequence[str], date_col: str = "order_date") -> Column:
    """WIN6: 0-based day number within the series (set before warm-up drop)."""
    return (F.row_number().over(series_window(keys, date_col)) - 1).cast("bigint").alias(
        "time_index")


def build_features(daily: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                   date_col: str = "order_date", drop_warmup: bool = True) -> DataFrame:
    """FEA1: calendar, lag, rolling and trend features in the fixed order of
    ``FEATURE_COLS``; warm-up rows (any null lag / rolling value) dropped
    (WIN5).  All window columns share one partitioning and ordering, so
    Spark evaluates them in a single sort per series."""
    keys = list(keys)
    feats = daily.select(
        *keys, date_col, "revenue", "quantity",
        *calendar_features(date_col),
        *lag_features(keys, "revenue", date_col=date_col),
        *rolling_features(keys, "revenue", date_col=date_col),
        time_index(keys, date_col),
    )
    if drop_warmup:
        history_cols = [c for c in FEATURE_COLS if "lag" in c or "roll" in c]
        feats = feats.where(F.greatest(*[F.col(c).isNull().cast("int") for c in history_cols]) == 0)
    return feats.select(*keys, date_col, "revenue", "quantity", *FEATURE_COLS)


def chrono_split(features: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                 test_size: float = 0.2, date_col: str = "order_date") -> DataFrame:
    """WIN7: per series, the first ``max(int(n*(1-test_size)), 1)`` rows are
    train, the rest test; with no test row left, the last row is test."""
    if not 0.0 < test_size < 0.5:
        raise ValueError("test_size must be in (0, 0.5)")
    keys = list(keys)
    w = series_window(keys, date_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    split = F.greatest(F.floor(n * F.lit(1.0 - test_size)), F.lit(1))
    split = F.when(split >= n, n - 1).otherwise(split)
    return features.withColumn("_rn", F.row_number().over(w)).withColumn(
        "is_train", F.col("_rn") <= split).drop("_rn")


def forward_fill(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 date_col: str = "order_date") -> DataFrame:
    """FIL1: nulls take the series' last non-null value (leading nulls
    stay null); a running window over one series' days."""
    w = series_window(keys, date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in columns else F.col(c)
                       for c in df.columns])
