"""Small files folded, and the log read newest day first."""
import datetime as dt
import os

from pyspark.sql import functions as F

from tidemark.operators.activity import latest_activity, recent_activity
from tidemark.sinks import store as st


def files(root):
    return [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")]


def test_appends_are_folded_and_read_unchanged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FOLD_FILES", 4)
    store = st.Store(spark, str(tmp_path / "tables"))
    when = dt.datetime(2024, 1, 1, 12)
    for i in range(11):
        store.log_activity(i % 2, "model_train", {"n": i}, when=when + dt.timedelta(seconds=i))
    assert len(files(store.path("activity"))) <= 5
    rows = store.activity().orderBy("created_at").collect()
    assert [r.user_id for r in rows] == [i % 2 for i in range(11)]
    points = spark.createDataFrame([("m", dt.date(2024, 1, 1), 1.0, 0.0, 2.0, .5, "category=all;region=all", when)], st.PREDICTION_SCHEMA)
    for _ in range(7):
        store.append_predictions(points)
    assert store.predictions().count() == 7 and len(files(store.path("predictions"))) <= 5
    assert not files(os.path.join(store.root, "_fold"))


def test_newest_days_only_and_the_same_rows(spark, tmp_path):
    rows = [(i, i % 3, "login", None, None, dt.datetime(2024, 1, 1 + i // 10, 0, i % 10 // 2)) for i in range(200)]
    log = spark.createDataFrame(rows, st.ACTIVITY_SCHEMA).withColumn("day", F.to_date("created_at"))
    log.write.partitionBy("day").parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    for user, limit, days in ((None, 7, 1), (None, 15, 2), (2, 10, 4), (None, 1000, 20)):
        got = latest_activity(stored, user, limit)
        want = recent_activity(log.drop("day"), user, limit)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.select(got.columns).collect()]
        read = got.select(F.to_date("created_at").alias("d")).distinct().count()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert read <= days
        assert ("PartitionFilters: [isnotnull(day" in plan) == (limit < 1000)
    assert latest_activity(stored.where("false")).count() == 0
