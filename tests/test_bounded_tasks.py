"""Stored builds deal larger sources to more tasks; per-dataset decisions
are joined without dealing the rows by dataset."""
import os

from pyspark.sql import functions as F

from tidemark.functions.columns import to_double_strict
from tidemark.operators.ingest import _first_rows, validate_and_clean
from tidemark.session import write_once
from tidemark.sinks.store import Store
from tidemark.sources.warehouse import stored_table
from tidemark.streaming import file_ingest

KEYS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")


def test_build_has_more_tasks_for_larger_sources_and_settings_return(spark, tmp_path):
    spark.range(3_000_000).select(F.rand(7).alias("x")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "events.parquet").glob("*.parquet"))
    before, seen = [spark.conf.get(k) for k in KEYS], []

    def build(sp, d):
        seen.append([sp.conf.get(k) for k in KEYS])
        return sp.read.parquet(os.path.join(d, "events.parquet"))

    rows = stored_table(spark, str(tmp_path), "bounded_probe", build, sources=("events",), partition_by=None)
    assert rows.count() == 3_000_000
    assert int(before[0]) < int(seen[0][0]) and 2 * size <= int(seen[0][0]) * (8 << 20)
    assert int(seen[0][1]) <= 8 << 20 and int(seen[0][2]) <= 16 << 20
    assert [spark.conf.get(k) for k in KEYS] == before


def _row_exchanges(df) -> int:
    """Shuffles in the plan, run and all."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_decisions_reach_the_rows_without_a_shuffle_of_them(spark):
    raw = spark.createDataFrame([(d, i, "2024-01-01", str(i)) for d in (1, 2) for i in range(4)], "dataset_id bigint, _row bigint, Date string, Revenue string")
    clean, _ = validate_and_clean(raw)
    assert clean.count() == 8
    assert _row_exchanges(clean) == 0


def test_first_row_by_place_without_sorting_rows(spark):
    rows = [(1, ("f", 8, 0), "a"), (1, ("f", 0, 9), "a"), (1, ("e", 3, 4), "b"), (1, ("e", 3, 2), "b"), (2, ("e", 0, 7), "a")]
    df = spark.createDataFrame(rows, "dataset_id bigint, _row struct<file:string,at:bigint,row:bigint>, order_date string")
    first = _first_rows(df)
    assert {(r.dataset_id, r.order_date, tuple(r._at)) for r in first.collect()} == {(1, "a", ("f", 0, 9)), (1, "b", ("e", 3, 2)), (2, "a", ("e", 0, 7))}
    assert first.schema["_at"].dataType.names == ["file", "at", "row"]
    flat = _first_rows(df.withColumn("_row", F.col("_row.row")))
    assert {(r.dataset_id, r.order_date, r._at) for r in flat.collect()} == {(1, "a", 0), (1, "b", 2), (2, "a", 7)}


def test_reports_of_a_batch_read_the_typed_rows_once(spark, tmp_path, monkeypatch):
    path, reads = tmp_path / "a.csv", []
    path.write_text("Date,Revenue\n2024-01-01,5\n2024-01-02,6\n")

    def recorded(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        reads.append(sum("Relation [" in line and "_ts#" in line for line in plan))
        return write_once(df, name)

    monkeypatch.setattr(file_ingest, "write_once", recorded)
    store = Store(spark, str(tmp_path / "tables"))
    report = file_ingest.ingest_uploads(spark, [str(path)], store)
    assert report.first()["valid_rows"] == 2 and store.read("sales").count() == 2
    assert sum(reads) == 1


def test_numbers_are_told_by_their_first_character_and_shape(spark):
    texts = ["5", " +1.5e3 ", ".5", "-inf", "Infinity", "3d", "iron", "1,000", "", "NaN", "x5", "-", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(to_double_strict("t")).collect()]
    assert got == [5.0, 1500.0, 0.5, float("-inf"), float("inf")] + [None] * 8
