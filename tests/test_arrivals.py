"""Uploads as they arrive: grouped by header, folders of files, split scans."""
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.sinks.store import Store
from tidemark.sources.uploads import file_layouts, read_csv_files, read_upload_csv
from tidemark.streaming.file_ingest import ingest_uploads, start_file_ingest


def drained(spark, landing, store, checkpoint):
    start_file_ingest(spark, str(landing), store, str(checkpoint)).awaitTermination()


def jobs(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    run()
    n = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_jobs_follow_headers_not_files(spark, tmp_path):
    counts = {}
    for n in (40, 120):         # Spark lists more than 32 paths in a job of its own
        paths = []
        for i in range(n):
            p = tmp_path / f"{n}-{i}.csv"
            p.write_text(f"Date,Product,Revenue\n2024-01-01,A,{i + 1}\n2024-01-02,B,2\n")
            paths.append(str(p))
        store = Store(spark, str(tmp_path / f"tables-{n}"))
        counts[n] = jobs(spark, f"uploads-{n}", lambda: ingest_uploads(spark, paths, store))
        rows = store.datasets().collect()
        assert len(rows) == n and all((r.status, r.row_count) == ("processed", 2) for r in rows)
        sums = {r.dataset_id: r.s for r in store.read("sales").groupBy("dataset_id").agg(F.sum("revenue").alias("s")).collect()}
        assert sorted(sums.values()) == [i + 3.0 for i in range(n)]
        assert store.activity().where("action = 'dataset_upload'").count() == n
    assert counts[40] == counts[120]


def test_folder_is_one_dataset_and_late_files_replace_it(spark, tmp_path):
    landing, store = tmp_path / "landing dir", Store(spark, str(tmp_path / "tables"))
    (landing / "year #1").mkdir(parents=True)
    (landing / "year #1" / "part-1.csv").write_text("Date,Revenue\n01/02/2024,5\n")
    (landing / "year #1" / "part-2.csv").write_text("Date,Revenue\n01/03/2024,6\n")
    (landing / "one.csv").write_text('Date,Revenue,Product\n2024-01-01,7,"two\nlines"\n')
    drained(spark, landing, store, tmp_path / "checkpoint")
    got = {r.original_filename: (r.status, r.row_count) for r in store.datasets().collect()}
    assert got == {"year #1": ("processed", 2), "one.csv": ("processed", 1)}
    (landing / "year #1" / "part-3.csv").write_text("Date,Revenue\n01/04/2024,7\n")
    drained(spark, landing, store, tmp_path / "checkpoint")
    got = {r.original_filename: (r.status, r.row_count) for r in store.datasets().collect()}
    assert got == {"year #1": ("processed", 3), "one.csv": ("processed", 1)}
    assert store.read("sales").agg(F.sum("revenue")).first()[0] == 25.0


def test_folder_with_two_headers_and_a_bad_neighbour(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("Date,Revenue\n2024-01-01,1\n")
    (folder / "b.csv").write_text("Date,Region,Revenue\n2024-01-02,N,2\n")
    bad = tmp_path / "bad.txt"
    bad.write_text("Date,Revenue\n2024-01-01,1\n")
    store = Store(spark, str(tmp_path / "tables"))
    ingest_uploads(spark, [str(folder), str(bad)], store)
    got = {r.original_filename: (r.status, r.row_count) for r in store.datasets().collect()}
    assert got == {"mixed": ("processed", 2), "bad.txt": ("invalid", 0)}
    assert {r.region for r in store.read("sales").collect()} == {"N", "Unknown Region"}


def test_only_files_with_broken_quotes_are_read_whole(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text("Date,Product,Revenue\n" + "".join(f'2024-01-01,"x ""{i}"", y",{i}\n' for i in range(20000)))
    broken.write_text('Date,Product,Revenue\n2024-01-01,"a\nb",1\n')
    found = {r.file.split("/")[-1]: (r.header, r.broken) for r in file_layouts(spark, [str(plain), str(broken)]).collect()}
    assert found == {"plain.csv": ("Date,Product,Revenue", False), "broken.csv": ("Date,Product,Revenue", True)}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(100_000))
    try:
        assert read_csv_files(spark, [str(plain)], False).rdd.getNumPartitions() > 3
        rows = read_upload_csv(spark, str(plain), 1).orderBy("_row").collect()
        assert read_upload_csv(spark, str(broken), 1).first()["Product"] == "a\nb"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r["Revenue"] for r in rows] == [str(i) for i in range(20000)]
    assert rows[7]["Product"] == 'x "7", y'


def test_many_distinct_dates_are_read_in_place_with_the_same_result(spark, monkeypatch):
    from tidemark.operators import ingest
    raw = spark.createDataFrame([(d, i, v, "5") for d in (1, 2) for i, v in enumerate(
        ["13/01/2024", "2/03/2024", "bad", None, "2024-01-05", "1/2/2024 10:00"][::1 if d == 1 else -1])],
        "dataset_id int, _row int, Date string, Revenue string")
    results = []
    for most in (1000, 0):
        monkeypatch.setattr(ingest, "DATE_TEXTS", most)
        for mode in ("first_format", "lenient"):
            clean, _ = ingest.validate_and_clean(raw, date_mode=mode)
            results.append(sorted((r.dataset_id, str(r.order_date)) for r in clean.collect()))
    assert results[:2] == results[2:]
    assert (1, "2024-03-02") in results[0] and (2, "2024-01-02") in results[0]


def test_segments_of_every_level(spark):
    rows = [(1, "2024-01-01", "c1", "N", 10.0), (1, "2024-01-01", "c1", "S", 1.0), (1, "2024-01-02", "c2", "N", 5.0), (1, "2024-01-02", None, "N", 2.0)]
    sales = spark.createDataFrame(rows, "dataset_id long, order_date string, category string, region string, revenue double").withColumn("quantity", F.lit(1.0))
    got = {(r.segment, r.order_date): r.revenue for r in agg.segment_daily(sales).collect()}
    assert got == {("category=c1;region=N", "2024-01-01"): 10.0, ("category=c1;region=S", "2024-01-01"): 1.0, ("category=c2;region=N", "2024-01-02"): 5.0,
                   ("category=c1;region=all", "2024-01-01"): 11.0, ("category=c2;region=all", "2024-01-02"): 5.0,
                   ("category=all;region=N", "2024-01-01"): 10.0, ("category=all;region=S", "2024-01-01"): 1.0, ("category=all;region=N", "2024-01-02"): 7.0,
                   ("category=all;region=all", "2024-01-01"): 11.0, ("category=all;region=all", "2024-01-02"): 7.0}
