"""Business KPIs per dataset (KPI0-KPI13).

One partial-aggregating pass gives totals and date bounds; a month-level
pre-aggregate (keys x months rows, bounded by the calendar span) gives the
month and year growth; three small two-level aggregates give the top
entities.  Everything is joined on the keys — no window runs over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import accuracy_from_mape, pct_change, round_half_up

DEFAULT_KEYS = ("dataset_id",)
KPI_COLUMNS = ["total_revenue", "total_units_sold", "average_order_value", "total_orders",
               "revenue_growth_mom_pct", "revenue_growth_yoy_pct", "average_daily_revenue",
               "top_product", "top_category", "top_region", "forecast_accuracy_pct",
               "sales_target_achievement_pct"]


def top_entity(sales: DataFrame, column: str, keys: Sequence[str], alias: str | None = None
               ) -> DataFrame:
    """KPI8-10: value of ``column`` with the largest revenue per key; ties
    go to the smallest value; null values are ignored.  Two partial
    aggregates: (keys, value) sums, then a min over (-revenue, value)."""
    keys = list(keys)
    alias = alias or f"top_{column}"
    per_value = (sales.where(F.col(column).isNotNull())
                 .groupBy(*keys, F.col(column).cast("string").alias("_v"))
                 .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("_r")))
    return per_value.groupBy(*keys).agg(_argmax_min_key("_r", "_v").alias(alias))


def _argmax_min_key(value: str | Column, key: str | Column, cond: Column | None = None
                    ) -> Column:
    """Aggregate: key with the largest value, smallest key on ties."""
    v = F.col(value) if isinstance(value, str) else value
    k = F.col(key) if isinstance(key, str) else key
    s = F.struct((-F.coalesce(v, F.lit(0.0))).alias("neg"), k.alias("k"))   # all null sums to 0
    return F.min(s if cond is None else F.when(cond, s)).getField("k")


def _sum_year(months: Column, year: Column) -> Column:
    in_year = F.map_filter(months, lambda k, v: F.year(k) == year)
    return F.aggregate(F.map_values(in_year), F.lit(0.0), lambda acc, x: acc + x)


def _growth_columns(lo_m: Column, hi_m: Column, months: Column) -> list[Column]:
    """MoM / YoY from a key's month -> revenue map (bounded by its span).
    The previous period counts as 0 when it has no sales (growth null)."""
    cur_m = F.try_element_at(months, hi_m)
    prev_m = F.coalesce(F.try_element_at(months, F.add_months(hi_m, -1)), F.lit(0.0))
    cur_y, prev_y = _sum_year(months, F.year(hi_m)), _sum_year(months, F.year(hi_m) - 1)
    return [
        F.when(lo_m < hi_m, pct_change(cur_m, prev_m)).alias("revenue_growth_mom_pct"),
        F.when(F.year(lo_m) < F.year(hi_m), pct_change(cur_y, prev_y))
        .alias("revenue_growth_yoy_pct"),
    ]


def period_growth(sales: DataFrame, keys: Sequence[str], date_col: str = "order_date"
                  ) -> DataFrame:
    """KPI6-7: month-over-month and year-over-year revenue growth %.

    The last period is the one holding the key's last sale; the previous
    period is the calendar period before it, counted as 0 when it has no
    sales (so growth is null), and growth is null with a single period.
    Monthly sums are partial-aggregated, then each key folds its months
    (one entry per calendar month) into a map."""
    keys = list(keys)
    monthly = sales.groupBy(*keys, F.trunc(date_col, "month").alias("_m")).agg(
        F.sum("revenue").alias("_mrev"))
    per_key = monthly.groupBy(*keys).agg(
        F.min("_m").alias("_lo_m"), F.max("_m").alias("_hi_m"),
        F.map_from_entries(F.collect_list(F.struct("_m", "_mrev"))).alias("_months"))
    return per_key.select(*keys, *_growth_columns(F.col("_lo_m"), F.col("_hi_m"),
                                                   F.col("_months")))


def compute_kpis(
    sales: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    active_models: DataFrame | None = None,
    sales_target: float | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """KPI0: one row per key with every KPI.

    ``active_models`` (keys + ``mape``) feeds forecast accuracy (KPI11, JON3);
    ``sales_target`` feeds target achievement (KPI12); ``catalog`` (keys)
    keeps keys without sales as a zero row.  A pre-aggregated input may
    carry ``n_rows`` (rows behind each aggregated row) for the order count.
    """
    keys = list(keys)
    dims = [c for c in ("product", "category", "region") if c not in keys]
    # One scan: grouping sets (keys, month) + (keys, dim) for each dim, all
    # partial-aggregated before a single shuffle.
    sales = sales.withColumn("_m", F.trunc("order_date", "month"))
    sets = [keys + ["_m"]] + [keys + [d] for d in dims]
    g = sales.groupingSets(sets, *keys, "_m", *dims).agg(
        F.sum("revenue").alias("_rev"), F.sum("quantity").alias("_units"),
        (F.sum("n_rows") if "n_rows" in sales.columns else F.count(F.lit(1))).alias("_n"),
        F.min("order_date").alias("_lo"), F.max("order_date").alias("_hi"),
        F.grouping("_m").alias("_g_m"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    is_m = F.col("_g_m") == 0

    def m_only(c: str) -> Column:
        return F.when(is_m, F.col(c))

    tops = [_argmax_min_key("_rev", F.col(d).cast("string"),
                            (F.col(f"_g_{d}") == 0) & F.col(d).isNotNull()).alias(f"top_{d}")
            for d in dims]
    per_key = g.groupBy(*keys).agg(
        F.sum(m_only("_rev")).alias("_rev"), F.sum(m_only("_units")).alias("_units"),
        F.sum(m_only("_n")).alias("_orders"),
        F.min(m_only("_lo")).alias("_lo"), F.max(m_only("_hi")).alias("_hi"),
        F.min(m_only("_m")).alias("_lo_m"), F.max(m_only("_m")).alias("_hi_m"),
        F.map_from_entries(F.collect_list(F.when(is_m, F.struct("_m", "_rev"))))
        .alias("_months"),
        *tops,
    )
    out = per_key.select("*", *_growth_columns(F.col("_lo_m"), F.col("_hi_m"),
                                                F.col("_months")))
    for k in keys:
        if k in ("product", "category", "region"):
            out = out.withColumn(f"top_{k}", F.col(k).cast("string"))
    if active_models is not None:
        out = out.join(active_models.select(*keys, F.col("mape").alias("_mape")), keys, "left")
    else:
        out = out.withColumn("_mape", F.lit(None).cast("double"))
    if catalog is not None:
        out = catalog.select(*keys).distinct().join(out, keys, "left")

    rev = F.coalesce(F.col("_rev"), F.lit(0.0))
    orders = F.coalesce(F.col("_orders"), F.lit(0)).cast("bigint")
    n_days = F.greatest(F.datediff("_hi", "_lo") + 1, F.lit(1))
    has_rows = F.col("_lo").isNotNull()
    target = (F.when(has_rows, round_half_up(rev / F.lit(float(sales_target)) * 100, 2))
              if sales_target else F.lit(None).cast("double"))
    return out.select(
        *keys,
        round_half_up(rev, 2).alias("total_revenue"),
        round_half_up(F.coalesce(F.col("_units"), F.lit(0.0)), 2).alias("total_units_sold"),
        F.when(orders > 0, round_half_up(rev / orders, 2)).otherwise(F.lit(0.0))
        .alias("average_order_value"),
        orders.alias("total_orders"),
        "revenue_growth_mom_pct", "revenue_growth_yoy_pct",
        F.when(has_rows, round_half_up(rev / n_days, 2)).otherwise(F.lit(0.0))
        .alias("average_daily_revenue"),
        "top_product", "top_category", "top_region",
        F.when(has_rows, accuracy_from_mape("_mape")).alias("forecast_accuracy_pct"),
        target.alias("sales_target_achievement_pct"),
    )
