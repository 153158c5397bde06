"""Canonical schemas and the fixed values the engine must share with the
behaviour it reproduces."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — these must stay exactly as written for matching results.
# ---------------------------------------------------------------------------

# Canonical field -> header keywords (lower case), in matching order.
COLUMN_ALIASES: dict[str, list[str]] = {
    "order_date": ["date", "order date", "order_date", "invoice date", "sale date",
                   "transaction date", "orderdate", "time", "timestamp"],
    "product": ["product", "product name", "item", "item name", "sku", "product_name", "title"],
    "category": ["category", "product category", "segment", "product_category", "type",
                 "dept", "department"],
    "region": ["region", "state", "country", "location", "market", "territory", "city"],
    "quantity": ["quantity", "qty", "units", "units sold", "quantity sold", "items_sold", "count"],
    "unit_price": ["unit price", "price", "unit_price", "price per unit", "rate", "cost_per_unit"],
    "revenue": ["revenue", "sales", "total sales", "amount", "total amount", "total",
                "sales amount", "grand total", "total_price", "price_total"],
    "cost": ["cost", "unit cost", "cogs", "total cost", "expense"],
}
REQUIRED_FIELDS = ["order_date"]
OPTIONAL_FIELDS = ["product", "category", "region", "quantity", "unit_price", "revenue", "cost"]
NUMERIC_FIELDS = ["quantity", "unit_price", "revenue", "cost"]
TEXT_DEFAULTS = {
    "product": "Unknown Product",
    "category": "Uncategorized",
    "region": "Unknown Region",
}
ALLOWED_UPLOAD_EXTENSIONS = [".csv", ".xlsx", ".xls"]
# Tokens pandas' CSV reader reads as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

DATASET_STATUSES = ["uploaded", "validating", "valid", "invalid", "processed"]
ACTIVITY_ACTIONS = ["register", "login", "dataset_upload", "model_train", "forecast_predict"]

AVAILABLE_ALGORITHMS = ["gradient_boosting", "random_forest", "xgboost", "lightgbm", "prophet"]

# Feature set, names and order fixed.
LAGS = [1, 2, 3, 7, 14, 30]
ROLL_WINDOWS = [7, 14, 30]
CALENDAR_FEATURES = ["day_of_week", "day_of_month", "month", "quarter", "year",
                     "week_of_year", "is_weekend", "is_month_start", "is_month_end"]
FEATURE_COLS = (
    CALENDAR_FEATURES
    + [f"revenue_lag_{n}" for n in LAGS]
    + [c for w in ROLL_WINDOWS for c in (f"revenue_roll_mean_{w}", f"revenue_roll_std_{w}")]
    + ["time_index"]
)
WARMUP_DAYS = max(LAGS + ROLL_WINDOWS)

MIN_SALES_ROWS = 15
MIN_FEATURE_ROWS = 5
DEFAULT_HORIZON = 30
MAX_HORIZON = 365
RECENT_ACTIVITY_USER_LIMIT = 200
RECENT_ACTIVITY_ALL_LIMIT = 500
TOP_PRODUCTS = 10
TREND_FREQS = ["D", "W", "ME"]

# ---------------------------------------------------------------------------
# Canonical tables
# ---------------------------------------------------------------------------

SALES_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.LongType(), False),
    T.StructField("order_date", T.DateType(), False),
    T.StructField("product", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("quantity", T.DoubleType(), True),
    T.StructField("unit_price", T.DoubleType(), True),
    T.StructField("revenue", T.DoubleType(), True),
    T.StructField("cost", T.DoubleType(), True),
])
SALES_COLUMNS = [f.name for f in SALES_SCHEMA.fields]

REPORT_SCHEMA = T.StructType([
    T.StructField("is_valid", T.BooleanType(), False),
    T.StructField("total_rows", T.LongType(), False),
    T.StructField("valid_rows", T.LongType(), False),
    T.StructField("invalid_rows", T.LongType(), False),
    T.StructField("missing_columns", T.ArrayType(T.StringType()), False),
    T.StructField("detected_columns", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("warnings", T.ArrayType(T.StringType()), False),
    T.StructField("errors", T.ArrayType(T.StringType()), False),
])

DATASET_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.LongType(), False),
    T.StructField("owner_id", T.LongType(), False),
    T.StructField("filename", T.StringType(), True),
    T.StructField("original_filename", T.StringType(), True),
    T.StructField("file_path", T.StringType(), True),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("validation_report", T.StringType(), True),
    T.StructField("uploaded_at", T.TimestampType(), True),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType(), False),
    T.StructField("target_date", T.DateType(), False),
    T.StructField("predicted_revenue", T.DoubleType(), False),
    T.StructField("lower_bound", T.DoubleType(), True),
    T.StructField("upper_bound", T.DoubleType(), True),
    T.StructField("confidence_score", T.DoubleType(), True),
    T.StructField("segment", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

ACTIVITY_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("details", T.StringType(), True),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])
