"""Revenue trend, breakdowns, top-k, overview and daily series (AGG1-4, AGG6).

All operators are keyed: ``keys`` names the dataset (or series) columns,
so one job answers every dataset at once.  Aggregations are partial
(map-side combine) before their shuffle; windows only ever run over
already-aggregated rows, and totals are joined back from a one-row-per-key
aggregate instead of a whole-key window.

Where an aggregated frame feeds two branches (rows + totals, rows +
calendar bounds) it is written once to the shared checkpoint folder
(``materialize``): the branches prune different columns, so Spark could not
reuse one exchange, and the scan below (often a multi-way join) would
otherwise run twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import bucket_end, calendar_by_key, check_freq
from tidemark.functions.columns import round_half_up, segment_label
from tidemark.session import materialize

DEFAULT_KEYS = ("dataset_id",)


def revenue_trend(sales: DataFrame, freq: str = "D", keys: Sequence[str] = DEFAULT_KEYS,
                  date_col: str = "order_date") -> DataFrame:
    """AGG1: sums of revenue and units per period; empty periods give 0.
    Period label is the bucket end as ``yyyy-MM-dd``."""
    keys = list(keys)
    check_freq(freq)
    bucketed = materialize(sales.groupBy(*keys, bucket_end(date_col, freq).alias("_bucket")).agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units")))
    cal = calendar_by_key(bucketed, keys, "_bucket", freq, out_col="_bucket")
    return cal.join(bucketed, keys + ["_bucket"], "left").select(
        *keys,
        F.date_format("_bucket", "yyyy-MM-dd").alias("period"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("units", F.lit(0.0)).alias("units"),
    )


def breakdown(sales: DataFrame, column: str, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """AGG2: revenue, units and share % of the key's total per value of
    ``column``; null values dropped; an absent column gives no rows."""
    keys = list(keys)
    out_schema = keys + ["label", "revenue", "units", "share_pct"]
    if column not in sales.columns:
        return sales.select(*keys, F.lit(None).cast("string").alias("label"),
                            F.lit(None).cast("double").alias("revenue"),
                            F.lit(None).cast("double").alias("units"),
                            F.lit(None).cast("double").alias("share_pct")).limit(0)
    grouped = materialize(sales.where(F.col(column).isNotNull())
                          .groupBy(*keys, F.col(column).cast("string").alias("label"))
                          .agg(F.sum("revenue").alias("revenue"),
                               F.sum("quantity").alias("units")))
    # one row per key; Spark broadcasts it if it is small
    totals = grouped.groupBy(*keys).agg(F.sum("revenue").alias("_total"))
    return grouped.join(totals, keys).select(
        *keys, "label", "revenue", "units",
        F.when(F.col("_total") != 0, round_half_up(F.col("revenue") / F.col("_total") * 100, 2))
        .otherwise(F.lit(0.0)).alias("share_pct"),
    ).select(*out_schema)


def top_k(breakdown_df: DataFrame, k: int, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """AGG3: first ``k`` rows of a breakdown per key, by revenue desc then
    label.  ``row_number() <= k`` lets Spark apply a partial group limit
    before the shuffle, so each key's final task sees at most
    k x partitions rows."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("revenue").desc(), F.col("label").asc())
    return (breakdown_df.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def overview(datasets: DataFrame, sales: DataFrame, keys: Sequence[str] = DEFAULT_KEYS
             ) -> DataFrame:
    """AGG4: per catalogued dataset, total revenue and orders (0 when it
    has no rows), with its stored row count and status.  One grouped pass
    over the sales plus a left join from the catalogue replaces a query per
    dataset.  A catalogue without ``row_count``/``status`` gets them from
    the same aggregate (processed when it holds rows)."""
    keys = list(keys)
    per = sales.groupBy(*keys).agg(F.sum("revenue").alias("_rev"),
                                   F.count(F.lit(1)).alias("_orders"))
    j = datasets.join(per, keys, "left")
    stored = F.coalesce(F.col("_orders"), F.lit(0)).cast("bigint")
    row_count = F.col("row_count") if "row_count" in datasets.columns else stored
    status = (F.col("status") if "status" in datasets.columns
              else F.when(stored > 0, F.lit("processed")).otherwise(F.lit("invalid")))
    return j.select(
        *keys, "original_filename", row_count.alias("row_count"), status.alias("status"),
        F.coalesce(round_half_up("_rev", 2), F.lit(0.0)).alias("total_revenue"),
        F.coalesce("_orders", F.lit(0)).cast("bigint").alias("total_orders"),
    )


def daily_revenue(sales: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                  date_col: str = "order_date", with_counts: bool = False,
                  fill: float | None = 0.0) -> DataFrame:
    """AGG6: revenue and quantity per day on a gap-free calendar from each
    key's first to last day; missing days are 0.0 (JON1: calendar left join).
    ``with_counts`` adds ``n_rows``, the sales rows behind each day;
    ``fill=None`` leaves missing days null (for forward filling)."""
    keys = list(keys)
    aggs = [F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity")]
    if with_counts:
        aggs.append(F.count(F.lit(1)).alias("n_rows"))
    per_day = materialize(sales.groupBy(*keys, F.col(date_col).alias("order_date")).agg(*aggs))
    cal = calendar_by_key(per_day, keys, "order_date", "D", out_col="order_date")
    extra = [F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")] if with_counts else []
    return cal.join(per_day, keys + ["order_date"], "left").select(
        *keys, "order_date",
        (F.col("revenue") if fill is None else F.coalesce("revenue", F.lit(fill))).alias("revenue"),
        (F.col("quantity") if fill is None else F.coalesce("quantity", F.lit(fill)))
        .alias("quantity"),
        *extra,
    )


def segment_daily(sales: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, date_col: str = "order_date") -> DataFrame:
    """FCT1 for every segment at once: revenue and quantity per day of each
    category and region, of each alone and of all, from one aggregate over
    grouping sets.  ``segment`` is labelled as predictions are (SNK3);
    ``category`` and ``region`` are null where a level means all; rows whose
    own category or region is null count under ``all`` only."""
    keys = list(keys)
    day = F.col(date_col).alias("order_date")
    base = sales.groupBy(*keys, day, "category", "region").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"))
    dims = [*keys, "order_date"]
    sets = [[*dims, "category", "region"], [*dims, "category"], [*dims, "region"], dims]
    cube = base.groupingSets([[F.col(c) for c in s] for s in sets], *dims, "category", "region").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"),
        F.grouping("category").alias("_c"), F.grouping("region").alias("_r"))
    cube = cube.where(((F.col("_c") == 1) | F.col("category").isNotNull()) & ((F.col("_r") == 1) | F.col("region").isNotNull()))
    return cube.select(*keys, segment_label(F.col("category"), F.col("region")).alias("segment"), "category", "region",
                       "order_date", "revenue", "quantity")
