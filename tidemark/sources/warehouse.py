"""Readers for the shared parquet tables and the canonical views built on
them.

``sales_view`` is the canonical sales fact (the shape the ingest operators
produce) derived from the order tables:

    dataset_id := customer market segment     order_date := order date
    product    := part name                   category   := part type
    region     := region name                 quantity   := line quantity
    unit_price := extended price / quantity   revenue    := extended price * (1 - discount)
    cost       := null

Join order keeps the big fact shuffled as few times as possible: orders are
first joined to customer (with its nation/region geography), then line
items are joined to that on order key, then to part.  The geography is
broadcast explicitly — nation and region have 25 and 5 rows at every scale
factor.  Every other choice is Spark's size-checked auto-broadcast (and
AQE at runtime), with sort-merge joins beyond the limit.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity",
                    "l_extendedprice", "l_discount")
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")

    geo = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "r_name"))
    cust_geo = cust.join(geo, cust.c_nationkey == geo.n_nationkey).select(
        "c_custkey", "c_mktsegment", "r_name")
    order_dim = orders.join(cust_geo, orders.o_custkey == cust_geo.c_custkey).select(
        "o_orderkey", "o_orderdate", "c_mktsegment", "r_name")
    fact = li.join(order_dim, li.l_orderkey == order_dim.o_orderkey).join(
        part, li.l_partkey == part.p_partkey)
    return fact.select(
        F.col("c_mktsegment").alias("dataset_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("r_name").alias("region"),
        F.col("l_quantity").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.nullif(F.col("l_quantity"), F.lit(0.0)))
        .alias("unit_price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.lit(None).cast("double").alias("cost"),
    )


# Materialised fact tables, one per (session, source snapshot).
_SALES_TABLES: dict = {}


def snapshot(spark: SparkSession, sf_dir: str, names) -> tuple:
    """Identity of the source files (path, size, mtime) through Hadoop's
    FileSystem: a changed table gets a fresh derived table, not a stale one."""
    from tidemark.session import file_signature
    return tuple(file_signature(spark, table_path(sf_dir, n)) for n in names)


ORDER_TABLES = ["lineitem", "orders", "customer", "nation", "region", "part"]


def stored_table(spark: SparkSession, sf_dir: str, name: str, build, sources=ORDER_TABLES,
                 partition_by: str | None = "dataset_id") -> DataFrame:
    """``build(spark, sf_dir)`` written once per (session, source snapshot)
    to the shared folder and read back by every caller.  The build sorts rows
    (merge joins, partitioned write), so its tasks are kept small."""
    from tidemark.session import bounded_tasks, path_exists, shared_path  # local: avoids an import cycle

    files = snapshot(spark, sf_dir, sources)
    key = (name, spark.sparkContext.applicationId, sf_dir.rstrip("/"), files)
    path = _SALES_TABLES.get(key)
    if path is None or not path_exists(spark, path.rstrip("/") + "/_SUCCESS"):
        path = shared_path(spark, name, f"{abs(hash(key)):x}")
        with bounded_tasks(spark, sum(size for _, found in files for _, size, _ in found or ())):
            w = build(spark, sf_dir).write.mode("overwrite")
            (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        _SALES_TABLES[key] = path
    return spark.read.parquet(path)


def sales_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical sales fact written once — Parquet partitioned by
    ``dataset_id`` in the shared folder, as the ingest stores uploads — and
    read back by every query.  The multi-way join behind ``sales_view`` then
    runs once per data snapshot instead of once per query, and reads by
    dataset prune partitions."""
    return stored_table(spark, sf_dir, "sales", sales_view)


# DuckDB text of the same view, for oracle queries.
SALES_VIEW_SQL = """
sales AS (
  SELECT c.c_mktsegment AS dataset_id,
         CAST(o.o_orderdate AS DATE) AS order_date,
         p.p_name AS product,
         p.p_type AS category,
         r.r_name AS region,
         l.l_quantity AS quantity,
         l.l_extendedprice / NULLIF(l.l_quantity, 0) AS unit_price,
         l.l_extendedprice * (1 - l.l_discount) AS revenue,
         CAST(NULL AS DOUBLE) AS cost
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def datasets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset catalogue derived from ``customer``: one dataset per market
    segment, owned by user ``min(custkey) % 3 + 1``, uploaded at a time
    derived from that key.  Row counts and status come from the sales
    aggregate of whichever query needs them, so the catalogue itself never
    scans the fact."""
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    per = cust.groupBy(F.col("c_mktsegment").alias("dataset_id")).agg(
        F.min("c_custkey").alias("_k"))
    return per.select(
        "dataset_id",
        (F.col("_k") % 3 + 1).cast("bigint").alias("owner_id"),
        F.concat(F.lower("dataset_id"), F.lit(".csv")).alias("original_filename"),
        F.timestamp_add("SECOND", F.col("_k"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("uploaded_at"),
    )


DATASETS_VIEW_SQL = """
datasets AS (
  SELECT c_mktsegment AS dataset_id,
         CAST(min(c_custkey) % 3 + 1 AS BIGINT) AS owner_id,
         lower(c_mktsegment) || '.csv' AS original_filename,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(min(c_custkey)) AS uploaded_at
  FROM customer GROUP BY c_mktsegment
)"""


def activity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity log stand-in from ``events``: user, action, JSON details,
    creation time."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type",
                    "props")
    return ev.select(
        "event_id", "user_id",
        F.col("event_type").alias("action"),
        F.col("props").alias("details"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("ts").alias("created_at"),
    )


ACTIVITY_VIEW_SQL = """
activity AS (
  SELECT event_id, user_id, event_type AS action, props AS details,
         CAST(NULL AS VARCHAR) AS ip_address, ts AS created_at
  FROM events
)"""
