"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import ensure_checkpoint_dir

# white space as the contracts define it: blank and U+0009 to U+000D
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST_ID = (1 << 63) - 1


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back:
    lineage is cut, and a lost executor re-reads files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other letters unchanged."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every row of ``vertices(id)``: the smallest id
    reachable over ``edges(a, b)``, itself included.

    Large-star / small-star rounds on the edges alone: each round links every
    vertex to the smallest vertex it sees, so path lengths shrink
    geometrically; only vertices that have an edge take part.  A vertex with
    very many neighbours is met by a min aggregate (partial sums first), never
    by a collected list.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(both.distinct(), "cc-edges")
    state = None
    for _ in range(max_rounds):
        # large star: neighbours above a vertex go to its smallest neighbour
        arcs = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = arcs.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = (arcs.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: lower neighbours and the vertex itself go to the smallest
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = stored(small, "cc-edges")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return vertices.join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))
