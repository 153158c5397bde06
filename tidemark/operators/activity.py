"""Activity log and listing operators (SRT1-SRT3, SRC4, SRC5, JSN1)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import RECENT_ACTIVITY_ALL_LIMIT, RECENT_ACTIVITY_USER_LIMIT, REPORT_SCHEMA


_DAY_FOLDER = re.compile(r"/day=(\d{4}-\d{2}-\d{2})/")


def recent_activity(activity: DataFrame, user_id: int | None = None,
                    limit: int | None = None) -> DataFrame:
    """SRT1/SRT2: newest first; one user's last 200 or everyone's last 500.
    ``orderBy(...).limit(n)`` plans as a top-k (TakeOrderedAndProject): each
    partition keeps n rows, so no full sort runs.  The event id breaks ties."""
    df = activity
    if user_id is not None:
        df = df.where(F.col("user_id") == F.lit(user_id))
        limit = limit or RECENT_ACTIVITY_USER_LIMIT
    else:
        limit = limit or RECENT_ACTIVITY_ALL_LIMIT
    return df.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(limit)


def latest_activity(log: DataFrame, user_id: int | None = None, limit: int | None = None) -> DataFrame:
    """SRT1/SRT2 over a log stored by ``day``: the newest days are counted in
    windows of 1, 2, 4, ... days until they hold enough rows, and the result
    reads no older day.  The driver sees names of day folders only."""
    limit = limit or (RECENT_ACTIVITY_ALL_LIMIT if user_id is None else RECENT_ACTIVITY_USER_LIMIT)
    days = sorted(set(_DAY_FOLDER.findall("\n".join(log.inputFiles()))), reverse=True)
    own = log if user_id is None else log.where(F.col("user_id") == F.lit(user_id))
    window = 1
    while window < len(days):
        recent = F.col("day") >= F.lit(days[window - 1]).cast("date")
        if own.where(recent).limit(limit).count() >= limit:
            return recent_activity(log.where(recent), user_id, limit).drop("day")
        window *= 2
    return recent_activity(log, user_id, limit).drop("day")


def visible_datasets(datasets: DataFrame, user_id: int, is_admin: bool) -> DataFrame:
    """SRC4 + SRT3: admins see every dataset, others their own; newest
    upload first."""
    return (datasets.where(F.lit(bool(is_admin)) | (F.col("owner_id") == F.lit(user_id)))
            .orderBy(F.col("uploaded_at").desc(), F.col("dataset_id")))


def get_dataset(datasets: DataFrame, dataset_id, user_id: int, is_admin: bool) -> DataFrame:
    """SRC5: point lookup with not-found / not-owner errors (one-row read)."""
    rows = datasets.where(F.col("dataset_id") == F.lit(dataset_id)).limit(1).collect()
    if not rows:
        raise LookupError("Dataset not found")
    if not is_admin and rows[0]["owner_id"] != user_id:
        raise PermissionError("Not authorized to access this dataset")
    return datasets.where(F.col("dataset_id") == F.lit(dataset_id))


def report_to_json(report: DataFrame) -> DataFrame:
    """JSN1: validation report struct -> JSON text column."""
    fields = [f.name for f in REPORT_SCHEMA.fields]
    return report.select("dataset_id", F.to_json(F.struct(*fields)).alias("validation_report"))


def report_from_json(text: DataFrame) -> DataFrame:
    """JSN1: JSON text -> typed report columns."""
    parsed = F.from_json("validation_report", REPORT_SCHEMA)
    return text.select("dataset_id", parsed.alias("r")).select("dataset_id", "r.*")


def details_map(activity: DataFrame) -> DataFrame:
    """JSN1: activity details JSON text -> map<string,string>."""
    return activity.withColumn(
        "details_map", F.from_json("details", T.MapType(T.StringType(), T.StringType())))
