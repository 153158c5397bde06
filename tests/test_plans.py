"""Physical-plan properties the design relies on at scale."""
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import forecast as fc
from tidemark.operators import kpi
from tidemark.sources.warehouse import sales_table

SF = "/root/testdata/sf0.001"


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_top_k_has_partial_group_limit(spark):
    plan = _physical(entry.queries()["top_products"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_latest_activity_is_take_ordered(spark):
    plan = _physical(entry.queries()["recent_activity_all"](spark, SF))
    assert "TakeOrderedAndProject" in plan


def test_dataset_read_prunes_partitions_and_pushes_filters(spark):
    df = fc.segment_filter(sales_table(spark, SF).where(F.col("dataset_id") == "BUILDING"),
                           region="ASIA").select("order_date", "revenue")
    plan = _physical(df)
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "BUILDING" in plan
    assert "EqualTo(region,ASIA)" in plan
    assert "ReadSchema: struct<order_date:date,region:string,revenue:double>" in plan


def test_kpis_read_the_fact_once(spark):
    plan = _optimized(kpi.compute_kpis(sales_table(spark, SF)))
    assert plan.count("Relation [") == 1
    assert "Expand" in plan
