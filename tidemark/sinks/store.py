"""Append-only tables in a shared folder (SNK1-SNK7, SRC3-SRC5).

Every table is Parquet; facts are partitioned by ``dataset_id`` so reads by
dataset prune partitions (SRC3) and a delete drops only those folders.  Writes are idempotent per batch:
the sales of a dataset are written with partition overwrite, so a retried
batch replaces rather than duplicates its rows.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.activity import latest_activity
from tidemark.session import has_data_files
from tidemark.schema import (ACTIVITY_ACTIONS, ACTIVITY_SCHEMA, DATASET_SCHEMA, DATASET_STATUSES,
                             PREDICTION_SCHEMA, SALES_COLUMNS, SALES_SCHEMA)


REGISTRY_SCHEMA = (
    "dataset_id bigint, model_id string, algorithm string, version string, file_path string, "
    "status string, mae double, rmse double, mape double, r2 double, hyperparameters string, "
    "is_active boolean, trained_at timestamp_ntz, kind string, implementation string, "
    "series_index double")
FOLD_FILES = 32             # files of a folder, beyond which appends are folded
FOLD_BYTES = 128 << 20
TABLE_SCHEMAS = {"sales": SALES_SCHEMA, "datasets": DATASET_SCHEMA, "models": REGISTRY_SCHEMA,
                 "predictions": PREDICTION_SCHEMA, "activity": ACTIVITY_SCHEMA}


class Store:
    """Table locations under one root (on a cluster: the shared folder)."""

    TABLES = ("sales", "datasets", "models", "predictions", "activity")

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def path(self, table: str) -> str:
        if table not in self.TABLES:
            raise ValueError(table)
        return self.root.rstrip("/") + "/" + table

    def exists(self, table: str) -> bool:
        """True when the table holds at least one data file (any file
        system Spark can read)."""
        return has_data_files(self.spark, self.path(table))

    def read(self, table: str, schema=None) -> DataFrame:
        """The table with its declared types: keys that became folder names
        are not guessed anew, and an empty table has the same types."""
        schema = schema or TABLE_SCHEMAS[table]
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    # --- sales -------------------------------------------------------------
    def append_sales(self, clean: DataFrame) -> None:
        """SNK1: write cleaned rows, replacing the datasets' partitions."""
        (clean.select(*SALES_COLUMNS).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy("dataset_id").parquet(self.path("sales")))

    def sales(self, dataset_id=None, category: str | None = None, region: str | None = None
              ) -> DataFrame:
        """SRC3: sales of one dataset (partition pruning), optional segment
        filters pushed to the scan; an empty typed frame when none."""
        return select_sales(self.read("sales"), dataset_id, category, region)

    # --- catalogue ---------------------------------------------------------
    def register_dataset(self, rows: DataFrame) -> None:
        """SNK1/SNK2: one catalogue row per dataset (status processed /
        invalid); a replayed upload replaces its row."""
        bad = rows.where(~F.col("status").isin(DATASET_STATUSES)).limit(1).count()
        if bad:
            raise ValueError("unknown dataset status")
        (rows.select(*[f.name for f in DATASET_SCHEMA.fields]).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy("dataset_id").parquet(self.path("datasets")))

    def datasets(self) -> DataFrame:
        return self.read("datasets", DATASET_SCHEMA)

    # --- registry / predictions / activity --------------------------------
    def append_models(self, registry: DataFrame) -> None:
        """SNK4: a run's model rows are appended; nothing is updated."""
        registry.write.mode("append").parquet(self.path("models"))
        self._fold("models")

    def models(self) -> DataFrame:
        return self.read("models")

    def append_predictions(self, records: DataFrame) -> None:
        """SNK3."""
        records = records.select(*[f.name for f in PREDICTION_SCHEMA.fields])
        records.write.mode("append").partitionBy("model_id").parquet(self.path("predictions"))
        self._fold("predictions")

    def predictions(self) -> DataFrame:
        return self.read("predictions", PREDICTION_SCHEMA)

    def log_activity(self, user_id: int, action: str, details: dict | None = None,
                     ip_address: str | None = None, when: dt.datetime | None = None) -> None:
        """SNK6: one audit row; details as JSON text."""
        if action not in ACTIVITY_ACTIONS:
            raise ValueError(f"unknown action {action!r}")
        when = when or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        row = (int(when.timestamp() * 1e6), int(user_id), action, json.dumps(details or {}),
               ip_address, when)
        self._append_activity(self.spark.createDataFrame([row], ACTIVITY_SCHEMA))

    def log_activities(self, rows: DataFrame, when: dt.datetime) -> None:
        """SNK6 for many events at once (``user_id``, ``action``,
        ``details``), in one write."""
        first = F.lit(int(when.timestamp() * 1e6))
        self._append_activity(rows.select(
            (first + F.monotonically_increasing_id()).alias("event_id"), "user_id", "action", "details",
            F.lit(None).cast("string").alias("ip_address"), F.lit(when).cast("timestamp").alias("created_at")))

    def _append_activity(self, rows: DataFrame) -> None:
        """The log is stored by day, so that its newest rows are in its
        newest folders."""
        rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(self.path("activity"))
        self._fold("activity")

    def activity(self) -> DataFrame:
        return self.activity_by_day().drop("day")

    def activity_by_day(self) -> DataFrame:
        return self.read("activity", T.StructType([*ACTIVITY_SCHEMA.fields, T.StructField("day", T.DateType())]))

    def recent_activity(self, user_id: int | None = None, limit: int | None = None) -> DataFrame:
        """SRT1/SRT2: newest rows first, older days unread."""
        return latest_activity(self.activity_by_day(), user_id, limit)

    def _fold(self, table: str) -> None:
        """Folders that appends left with more than ``FOLD_FILES`` files get
        one file for each ``FOLD_BYTES`` of them, written beside the folder and
        swapped in whole.  A table has one writer at a time."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path(table))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files: dict[str, list[int]] = {}
        found = fs.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            if f.getPath().getName().endswith(".parquet"):
                files.setdefault(f.getPath().getParent().toString(), []).append(f.getLen())
        for folder, sizes in files.items():
            if len(sizes) > FOLD_FILES:
                rows = self.spark.read.parquet(folder).coalesce(max(1, sum(sizes) // FOLD_BYTES))
                _rewrite(rows, folder, f"{self.root.rstrip('/')}/_fold/{uuid.uuid4().hex}")

    # --- delete ------------------------------------------------------------
    def delete_datasets(self, ids: DataFrame) -> None:
        """SNK7: drop datasets with their sales, catalogue rows, models,
        predictions and uploaded files.  Sales, catalogue and predictions are
        partitioned by dataset or model, so only those folders go and no other
        file is touched; children go before the catalogue row, so a delete
        that was cut short can be repeated.  Models hold one row per run and
        are rewritten beside the old table, which is dropped last."""
        ids = ids.select("dataset_id").distinct()
        gone = [r["dataset_id"] for r in ids.collect()]          # one row per deleted dataset
        if self.exists("models"):
            models = self.models()
            own = models.join(ids, "dataset_id", "left_semi")
            names = [r["model_id"] for r in own.select("model_id").distinct().collect()]
            self._drop_partitions("predictions", "model_id", names)
            _rewrite(cascade_delete(models, ids), self.path("models"))
        self._drop_partitions("sales", "dataset_id", gone)
        if self.exists("datasets"):
            files = self.datasets().join(ids, "dataset_id", "left_semi").select("file_path").collect()
            for r in files:
                if r["file_path"]:
                    _remove(self.spark, r["file_path"])
            self._drop_partitions("datasets", "dataset_id", gone)

    def _drop_partitions(self, table: str, key: str, values: Sequence) -> None:
        jvm = self.spark._jvm
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for v in values:
            _remove(self.spark, f"{self.path(table)}/{key}={escape(str(v))}")


def select_sales(sales: DataFrame, dataset_id=None, category: str | None = None, region: str | None = None) -> DataFrame:
    """SRC3/FCT1: rows of one dataset, category and region (those given)."""
    for column, value in (("dataset_id", dataset_id), ("category", category), ("region", region)):
        if value is not None and value != "":
            sales = sales.where(F.col(column) == F.lit(value))
    return sales.select("dataset_id", "order_date", "product", "category", "region",
                        "quantity", "unit_price", "revenue")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cascade_delete(child: DataFrame, deleted: DataFrame, keys: Sequence[str] = ("dataset_id",)
                   ) -> DataFrame:
    """JON4: rows of ``child`` whose parent was not deleted (left anti join).
    Spark broadcasts the id list if it is small and splits skewed keys
    otherwise."""
    return child.join(deleted.select(*keys).distinct(), list(keys), "left_anti")


def _rewrite(df: DataFrame, path: str, beside: str | None = None) -> None:
    """Written to a folder beside, then swapped in: the old one is renamed
    away first and removed last, so one whole copy exists at any moment."""
    spark, beside = df.sparkSession, beside or path
    df.write.mode("overwrite").parquet(beside + ".rewrite")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop.Path(beside + ".old")
    fs.delete(old, True)
    fs.rename(hadoop.Path(path), old)
    fs.rename(hadoop.Path(beside + ".rewrite"), hadoop.Path(path))
    fs.delete(old, True)
