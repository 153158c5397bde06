"""Dashboard payload per dataset (AGG5): KPIs + trend + three breakdowns
(top 10 products) nested as arrays of structs, one row per dataset.

The sales are pre-aggregated once to (dataset, day, product, category,
region) and checkpointed; every part is derived from that smaller panel,
so the fact scan runs once.  Nested arrays hold aggregated rows only
(periods, categories, regions, ten products).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import kpi
from tidemark.schema import TOP_PRODUCTS
from tidemark.session import materialize


def dashboard_payload(sales: DataFrame, freq: str = "D", keys: Sequence[str] = ("dataset_id",),
                      active_models: DataFrame | None = None,
                      sales_target: float | None = None) -> DataFrame:
    keys = list(keys)
    base = materialize(sales.groupBy(*keys, "order_date", "product", "category", "region").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"),
        F.count(F.lit(1)).alias("n_rows")))
    k = kpi.compute_kpis(base, keys, active_models, sales_target)
    kpi_cols = [c for c in k.columns if c not in keys]

    def nest(df: DataFrame, name: str, order: list[str], cols: list[str]) -> DataFrame:
        items = F.struct(*[F.col(c) for c in order + cols])
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(items)).alias(name))

    trend = agg.revenue_trend(base, freq, keys)
    by_cat = agg.breakdown(base, "category", keys).withColumn("neg", -F.col("revenue"))
    by_reg = agg.breakdown(base, "region", keys).withColumn("neg", -F.col("revenue"))
    by_prod = agg.top_k(agg.breakdown(base, "product", keys), TOP_PRODUCTS, keys)
    item = ["label", "revenue", "units", "share_pct"]
    return (k.select(*keys, F.struct(*kpi_cols).alias("kpis"))
            .join(nest(trend, "revenue_trend", ["period"], ["revenue", "units"]), keys, "left")
            .join(nest(by_cat, "by_category", ["neg"], item), keys, "left")
            .join(nest(by_reg, "by_region", ["neg"], item), keys, "left")
            .join(nest(by_prod, "by_product", ["rank"], item), keys, "left"))
