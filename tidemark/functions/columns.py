"""Column-expression helpers (JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: str | Column, places: int = 2) -> Column:
    """Round to ``places`` through decimal(38,6): stable against the last-bit
    noise of summation order, so ties round the same on every engine.
    Values outside the decimal range (or NaN/inf) fall back to a float round."""
    x = col_or(c)
    via_decimal = F.round(x.try_cast("decimal(38,6)"), places).cast("double")
    return F.coalesce(via_decimal, F.round(x, places))


def pct_change(current: str | Column, previous: str | Column) -> Column:
    """Percent change, null when the previous value is 0, null or NaN."""
    cur, prev = col_or(current), col_or(previous)
    bad = prev.isNull() | F.isnan(prev) | (prev == 0)
    return F.when(bad, F.lit(None).cast("double")).otherwise(
        round_half_up((cur - prev) / prev * 100, 2)
    )


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(col_or(num), F.nullif(col_or(den), F.lit(0)))


# Plain decimal / scientific numbers, and the special float words, told apart
# in one match: most text columns are neither.
_NUMBER = r"^[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
_NUMBER_STARTS = [ord(c) for c in "+-.0123456789iI"]


def to_double_strict(c: str | Column) -> Column:
    """Text -> double the way a strict numeric parser reads it.

    Only text shaped like a number is cast, so Spark's extra leniency (a
    trailing type suffix such as ``1d`` / ``2f``) is rejected, and text
    that is not a number never reaches the parser (a failed cast is costly
    per row).  Other first characters spare the regex.  NaN becomes null.
    """
    s = F.trim(col_or(c).cast("string"))
    return F.when(F.ascii(s).isin(_NUMBER_STARTS) & s.rlike(_NUMBER), s.try_cast("double")).otherwise(F.lit(None).cast("double"))


def confidence_from_mape(mape: str | Column) -> Column:
    """0.5 without MAPE; else max(0, 1 - mape/100) capped at 0.99, 3 places."""
    m = col_or(mape)
    score = F.least(F.greatest(F.lit(0.0), 1 - m / 100), F.lit(0.99))
    return F.when(m.isNull(), F.lit(0.5)).otherwise(round_half_up(score, 3))


def accuracy_from_mape(mape: str | Column) -> Column:
    """Forecast accuracy %: max(0, 100 - mape), 2 places; null without MAPE."""
    m = col_or(mape)
    return F.when(m.isNull(), F.lit(None).cast("double")).otherwise(
        round_half_up(F.greatest(F.lit(0.0), 100 - m), 2)
    )


def segment_label(category: str | Column, region: str | Column) -> Column:
    return F.concat(
        F.lit("category="), F.coalesce(col_or(category), F.lit("all")),
        F.lit(";region="), F.coalesce(col_or(region), F.lit("all")),
    )
