"""Upload sources (SRC1, SRC2) and deterministic "dirty upload" views.

``read_upload_csv`` reads files with every column as text (typing is the
ingest step's job), tags each row with its dataset and a file-order row
number, and refuses extensions outside the allowed list.

``dirty_upload_view`` / ``fallback_upload_view`` derive raw, messy upload
text from ``lineitem`` ⋈ ``orders`` ⋈ ``customer`` ⋈ ``part`` by fixed
rules on the line's row key (every row is kept; some values are replaced),
so the cleaning rules can be checked against SQL on the shared tables.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import ALLOWED_UPLOAD_EXTENSIONS
from tidemark.sources.warehouse import read_table, stored_table


def check_extension(path: str) -> str:
    """SRC2: only .csv / .xlsx / .xls (case-insensitive) are accepted;
    Excel must be converted to CSV first (no Spark reader for it here)."""
    ext = os.path.splitext(path)[1].lower()
    if ext not in ALLOWED_UPLOAD_EXTENSIONS:
        raise ValueError(f"Unsupported file type '{ext}'. Allowed: {ALLOWED_UPLOAD_EXTENSIONS}")
    if ext != ".csv":
        raise ValueError(f"'{ext}' uploads must be converted to CSV before ingest")
    return path


RESERVED = ("dataset_id", "_row", "_file", "_metadata")


def file_uri(spark: SparkSession, path: str) -> str:
    """``path`` as ``row_file`` names it: qualified and encoded, but for the
    scheme of local files, which is written in several ways."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p)
    return re.sub("^file:/+", "/", whole.toUri().toString())


def row_file() -> Column:
    """The file a row was read from."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def file_layouts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row a file: ``file`` (as readers name it), its first line as
    ``header``, and ``broken``, whether a quoted field of it holds a line
    break.  Read as plain lines, so that large files are split: a line with
    an odd number of quotes opens or closes a field of several lines."""
    lines = spark.read.text(list(paths)).select(
        row_file().alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("place"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return lines.groupBy("file").agg(F.min_by("value", "place").alias("header"), F.max(odd).alias("broken"))


def read_csv_files(spark: SparkSession, paths: Sequence[str], broken: bool) -> DataFrame:
    """CSV files of one header as all-string columns + ``_file`` and the
    file-order ``_row`` (a struct that sorts by file, then place).  Only
    files with line breaks inside quotes are read whole by one task each;
    the others are split.  A header that equals an internal name gets the
    suffix ``__src``."""
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("escape", '"').option("multiLine", broken).csv(list(paths)))
    named = [F.col(f"`{c}`").alias(f"{c}__src" if c.lower() in RESERVED else c) for c in df.columns]
    file = row_file()
    place = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    return df.select(file.alias("_file"), place.alias("_row"), *named)


def read_upload_csv(spark: SparkSession, path: str, dataset_id) -> DataFrame:
    """SRC1: one upload - a file, or a folder of files with one header - as
    all-string columns + ``dataset_id`` + file-order ``_row``.  Quotes inside
    quoted fields are doubled and quoted fields may hold line breaks; a
    header that equals an internal name gets the suffix ``__src``."""
    check_extension(path)
    broken = file_layouts(spark, [path]).agg(F.max("broken")).first()[0]
    return read_csv_files(spark, [path], bool(broken)).drop("_file").select(F.lit(dataset_id).alias("dataset_id"), "*")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
                    "l_quantity", "l_extendedprice", "l_discount")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    oc = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n),
                                                    F.col("c_nationkey") == n.n_nationkey)
    return (li.join(oc, li.l_orderkey == oc.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .withColumn("_row", F.col("l_orderkey") * 8 + F.col("l_linenumber")))


def _every(n: int) -> Column:
    return F.col("_row") % n == 0


def dirty_upload_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy text per segment dataset with headers
    ``Order Date, Product, Category, Region, Qty, Unit Price, Total Sales``:
    unparseable and foreign-format dates, missing / suffixed quantities,
    missing prices, missing, negative and thousands-separated revenue,
    missing product and region."""
    b = _base(spark, sf_dir)
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    date = (F.when(_every(101), F.lit("bad"))
            .when(_every(53), F.date_format("o_orderdate", "MM/dd/yyyy"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    qty = (F.when(_every(89), F.lit("")).when(_every(83), F.lit("3d"))
           .otherwise(F.col("l_quantity").cast("string")))
    unit = F.when(_every(79), F.lit("N/A")).otherwise(price.cast("string"))
    total = (F.when(_every(97), F.lit("")).when(_every(103), (-revenue).cast("string"))
             .when(_every(107), F.lit("1,000")).otherwise(revenue.cast("string")))
    return b.select(
        F.col("c_mktsegment").alias("dataset_id"), "_row",
        date.alias("Order Date"),
        F.when(_every(71), F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("Product"),
        F.col("p_type").alias("Category"),
        F.when(_every(73), F.lit("NA")).otherwise(F.col("n_name")).alias("Region"),
        qty.alias("Qty"), unit.alias("Unit Price"), total.alias("Total Sales"),
    )


def fallback_upload_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload with no revenue header: ``Order Date, Zeta, Alpha`` where
    ``Alpha`` holds some non-numeric text, so the revenue fallback must
    pick ``Zeta`` (quirk Q6)."""
    b = _base(spark, sf_dir)
    return b.select(
        F.col("c_mktsegment").alias("dataset_id"), "_row",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("l_extendedprice").cast("string").alias("Zeta"),
        F.when(_every(211), F.lit("x")).otherwise(F.col("l_quantity").cast("string"))
        .alias("Alpha"),
    )


def dirty_upload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty uploads stored once per data snapshot (as an uploaded file
    is stored once before it is processed)."""
    return stored_table(spark, sf_dir, "dirty_uploads", dirty_upload_view)


def fallback_upload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_table(spark, sf_dir, "fallback_uploads", fallback_upload_view)


DIRTY_BASE_SQL = """
base AS (
  SELECT l.*, o.o_orderdate, c.c_mktsegment, n.n_name, p.p_name, p.p_type,
         l.l_orderkey * 8 + l.l_linenumber AS _row
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

DIRTY_UPLOAD_SQL = """
raw AS (
  SELECT c_mktsegment AS dataset_id, _row,
    CASE WHEN _row % 101 = 0 THEN 'bad'
         WHEN _row % 53 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date_s,
    CASE WHEN _row % 71 = 0 THEN NULL ELSE p_name END AS product_s,
    p_type AS category_s,
    CASE WHEN _row % 73 = 0 THEN NULL ELSE n_name END AS region_s,
    CASE WHEN _row % 89 = 0 THEN NULL WHEN _row % 83 = 0 THEN NULL
         ELSE l_quantity END AS qty,
    CASE WHEN _row % 79 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS price,
    CASE WHEN _row % 97 = 0 THEN NULL
         WHEN _row % 103 = 0 THEN -(l_extendedprice * (1 - l_discount))
         WHEN _row % 107 = 0 THEN NULL
         ELSE l_extendedprice * (1 - l_discount) END AS rev
  FROM base
)"""
