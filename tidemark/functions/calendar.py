"""Calendar helpers: period buckets, per-key gap-free calendars and calendar
features.  Calendars are built from each key's own bounds with
``sequence`` + ``explode`` — a per-key generator, never a global range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import TREND_FREQS


def check_freq(freq: str) -> str:
    if freq not in TREND_FREQS:
        raise ValueError(f"freq must be one of {TREND_FREQS}, got {freq!r}")
    return freq


def bucket_end(date_col: str | Column, freq: str) -> Column:
    """Label of the period holding ``date``: the day itself (D), the Sunday
    closing its Monday-based week (W), or the last day of its month (ME)."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    check_freq(freq)
    if freq == "D":
        return d
    if freq == "W":
        return F.date_add(F.to_date(F.date_trunc("week", d)), 6)
    return F.last_day(d)


def bucket_step(freq: str) -> Column:
    return {"D": F.expr("interval 1 day"), "W": F.expr("interval 7 days"),
            "ME": F.expr("interval 1 month")}[check_freq(freq)]


def calendar_by_key(
    df: DataFrame, keys: Sequence[str], date_col: str = "order_date", freq: str = "D",
    out_col: str | None = None,
) -> DataFrame:
    """One row per (keys, bucket) from each key's first to last bucket.

    Month buckets step over month *starts* and are then moved to month ends,
    so short months never break the sequence.
    """
    out_col = out_col or date_col
    bounds = df.groupBy(*keys).agg(
        F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi")
    )
    if freq == "ME":
        seq = F.sequence(F.trunc("_lo", "month"), F.trunc("_hi", "month"), bucket_step(freq))
        starts = bounds.select(*keys, F.explode(seq).alias("_m"))
        return starts.select(*keys, F.last_day("_m").alias(out_col))
    lo, hi = bucket_end("_lo", freq), bucket_end("_hi", freq)
    return bounds.select(*keys, F.explode(F.sequence(lo, hi, bucket_step(freq))).alias(out_col))


def calendar_features(date_col: str = "order_date") -> list[Column]:
    """day_of_week (Mon=0), day_of_month, month, quarter, year, ISO week,
    weekend flag, month start / end flags — all as bigint."""
    d = F.col(date_col)
    return [
        F.weekday(d).cast("bigint").alias("day_of_week"),
        F.dayofmonth(d).cast("bigint").alias("day_of_month"),
        F.month(d).cast("bigint").alias("month"),
        F.quarter(d).cast("bigint").alias("quarter"),
        F.year(d).cast("bigint").alias("year"),
        F.weekofyear(d).cast("bigint").alias("week_of_year"),
        (F.weekday(d) >= 5).cast("bigint").alias("is_weekend"),
        (F.dayofmonth(d) == 1).cast("bigint").alias("is_month_start"),
        (d == F.last_day(d)).cast("bigint").alias("is_month_end"),
    ]
