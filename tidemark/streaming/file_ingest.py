"""File-arrival ingest on Structured Streaming (SRC6).

The stream watches a landing folder; its checkpoint records which files were
taken, so each upload is taken once.  An upload is a CSV file in the folder,
or a sub-folder, whose files together are one dataset.

A micro-batch is cleaned by header, not by file: one pass over the lines
finds every file's header, datasets whose files have the same headers are
read and cleaned together, and their sales, catalogue rows and log rows are
each written once.  The number of jobs follows the number of different
headers, not of files.  Writes overwrite the datasets' partitions, so a batch
that is replayed after a failure, or a sub-folder that receives more files
later (all of them are read again), replaces what it wrote before.

A dataset is PROCESSED with its row count, or INVALID with the report and no
rows.  If a group of uploads cannot be read together, each of them is taken
on its own, so that one unreadable file never stops the others.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.activity import report_to_json
from tidemark.operators.ingest import validate_and_clean
from tidemark.schema import REPORT_SCHEMA
from tidemark.sinks.store import Store
from tidemark.session import write_once
from tidemark.sources.uploads import check_extension, file_layouts, file_uri, read_csv_files


ARRIVAL = "path string, modificationTime timestamp, length bigint, content binary"


def dataset_id_for(path_col) -> F.Column:
    """Stable id from the file path: a retried batch gets the same id."""
    return F.pmod(F.xxhash64(path_col), F.lit(2**62))


def _refused(spark: SparkSession, uploads: DataFrame, why: str) -> DataFrame:
    """Reports of uploads that hold no readable rows."""
    empty = spark.createDataFrame([(False, 0, 0, 0, [], {}, [], [why])], REPORT_SCHEMA)
    return uploads.select("dataset_id").distinct().crossJoin(empty)       # one row


def _files_of(spark: SparkSession, upload: str) -> list[str]:
    """The CSV files of an upload: itself, or those of its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(upload)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or fs.getFileStatus(path).isFile():
        return [upload]
    return sorted(f.getPath().toString() for f in fs.listStatus(path)
                  if f.isFile() and f.getPath().getName().lower().endswith(".csv"))


def _store(spark: SparkSession, uploads: DataFrame, clean: DataFrame | None, report: DataFrame, store: Store, owner_id: int) -> None:
    """Sales of the valid datasets, catalogue rows and log rows of all."""
    if clean is not None:
        valid = report.where("is_valid").select("dataset_id")
        store.append_sales(clean.join(valid, "dataset_id", "left_semi"))
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    name = F.regexp_extract(F.rtrim(F.col("upload"), F.lit("/")), "([^/]*)$", 1)
    rows = F.when(F.col("is_valid"), F.col("valid_rows")).otherwise(0).cast("bigint")
    outcome = report.select("dataset_id", "is_valid", "valid_rows")
    catalogue = report_to_json(report).join(outcome, "dataset_id").join(uploads.select("dataset_id", "upload").distinct(), "dataset_id").select(
        F.col("dataset_id").cast("bigint"), F.lit(owner_id).cast("bigint").alias("owner_id"), name.alias("filename"),
        name.alias("original_filename"), F.col("upload").alias("file_path"), rows.alias("row_count"),
        F.when(F.col("is_valid"), "processed").otherwise("invalid").alias("status"), "validation_report",
        F.lit(now).alias("uploaded_at"))
    store.register_dataset(catalogue)
    store.log_activities(report.select(
        F.lit(owner_id).cast("bigint").alias("user_id"), F.lit("dataset_upload").alias("action"),
        F.to_json(F.struct("dataset_id", rows.alias("rows"))).alias("details")), now)


def _ingest_group(spark: SparkSession, uploads: DataFrame, parts: list[tuple[list[str], bool]], store: Store, owner_id: int,
                  match: str, date_mode: str) -> DataFrame:
    """Uploads with the same headers, cleaned together; their reports.
    uploads: dataset_id, upload, file; parts: files and ``broken`` by header."""
    raw = None
    for files, broken in parts:
        part = read_csv_files(spark, files, broken)
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    ids = F.broadcast(uploads.select("dataset_id", F.col("file").alias("_file")))      # files of one batch
    raw = raw.join(ids, "_file").drop("_file")
    clean, report = validate_and_clean(raw, match=match, date_mode=date_mode)
    report = write_once(report, "ingest_reports")
    nothing = _refused(spark, uploads, "The file holds no data rows.")
    report = write_once(report.unionByName(nothing.join(report, "dataset_id", "left_anti")), "ingest_reports")
    _store(spark, uploads, clean, report, store, owner_id)
    return report


def ingest_uploads(spark: SparkSession, uploads: Sequence[str], store: Store, owner_id: int = 1,
                   match: str = "substring", date_mode: str = "first_format") -> DataFrame:
    """Uploads (files, or folders of files) of one micro-batch: validate,
    store the rows of the valid ones, catalogue all; their reports."""
    files = [(u, f, file_uri(spark, f)) for u in dict.fromkeys(uploads) for f in _files_of(spark, u)]       # names only
    table = spark.createDataFrame(files, "upload string, path string, file string").withColumn("dataset_id", dataset_id_for(F.col("upload")))
    found = {r["file"]: (r["header"], r["broken"]) for r in file_layouts(spark, [f for _, f, _ in files]).collect()}   # one row a file
    groups: dict[tuple, dict[str, list]] = {}
    for u in dict.fromkeys(uploads):
        mine = [(f, uri) for v, f, uri in files if v == u]
        headers = tuple(sorted({found[uri][0] for _, uri in mine if uri in found}))
        groups.setdefault(headers, {})[u] = mine

    def take(headers: tuple, members: dict[str, list]) -> DataFrame:
        mine = table.where(F.col("upload").isin(list(members)))
        if not headers:
            report = _refused(spark, mine, "The file could not be read: it is empty")
            _store(spark, mine, None, report, store, owner_id)
            return report
        parts = []
        for h in headers:
            same = [(f, found[uri][1]) for fs in members.values() for f, uri in fs if uri in found and found[uri][0] == h]
            parts += [(group, broken) for broken in (False, True) if (group := [f for f, b in same if bool(b) == broken])]
        for f in (f for files, _ in parts for f in files):
            check_extension(f)
        return _ingest_group(spark, mine, parts, store, owner_id, match, date_mode)

    reports = []
    for headers, members in groups.items():
        try:
            reports.append(take(headers, members))
        except (AnalysisException, Py4JJavaError, ValueError) as exc:
            if len(members) > 1:                # one of them is at fault: each on its own
                reports += [ingest_uploads(spark, [u], store, owner_id, match, date_mode) for u in members]
                continue
            mine = table.where(F.col("upload").isin(list(members)))
            report = _refused(spark, mine, f"The file could not be read: {exc}")
            _store(spark, mine, None, report, store, owner_id)
            reports.append(report)
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def ingest_file(spark: SparkSession, path: str, store: Store, owner_id: int = 1,
                match: str = "substring", date_mode: str = "first_format") -> DataFrame:
    """One upload; its report."""
    return ingest_uploads(spark, [path], store, owner_id, match, date_mode)


def start_file_ingest(spark: SparkSession, landing_dir: str, store: Store, checkpoint: str,
                      owner_id: int = 1, available_now: bool = True, files_per_trigger: int = 1000):
    """Start the stream; with ``available_now`` it drains what is there and
    stops (batch-style scheduling), otherwise it keeps watching.  Arrivals are
    listed by path alone (no content is read), so empty files are seen too."""
    arrivals = (spark.readStream.format("binaryFile").schema(ARRIVAL)
                .option("maxFilesPerTrigger", files_per_trigger)
                .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
                .load(landing_dir).select("path"))
    root = re.sub("^[a-z0-9]+:/+", "", landing_dir.rstrip("/")).lstrip("/")

    def upload_of(path: str) -> str:
        """The file in the landing folder, or the sub-folder that holds it."""
        head, _, rest = path.partition(root + "/")
        first, _, below = rest.partition("/")
        return f"{head}{root}/{first}" if below else path

    # Spark's file sources pass over files of no length: they are looked up
    # by name when the stream starts and with every batch.
    def empty_files() -> None:
        empty = _empty_uploads(spark, landing_dir)
        if empty:
            names = spark.createDataFrame([(p,) for p in empty], "file_path string")
            new = names.join(store.datasets().select("file_path"), "file_path", "left_anti").collect()
            if new:
                ingest_uploads(spark, [r["file_path"] for r in new], store, owner_id)

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        uploads = sorted({upload_of(r["path"]) for r in batch.select("path").distinct().collect()})   # file names only
        if uploads:
            ingest_uploads(spark, uploads, store, owner_id)
        empty_files()

    empty_files()
    writer = arrivals.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def _empty_uploads(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files of no length in a landing folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in fs.listStatus(path)
            if f.isFile() and f.getLen() == 0 and f.getPath().getName().lower().endswith(".csv")]
