"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the shared tables (or views Spark derives from them) in
full.  Doubles are rounded at the edge (2 places for money, 4 for
statistics) so results compare exactly against an independent SQL engine;
the operators themselves return unrounded values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import round_half_up
from tidemark.operators import aggregates as agg
from tidemark.operators import features as fe
from tidemark.operators import kpi
from tidemark.operators import metrics as evl
from tidemark.operators import selection as sel
from tidemark.plans import baselines
from tidemark.operators import ingest
from tidemark.sources import uploads
from tidemark.operators import activity as act
from tidemark.sinks.store import cascade_delete, select_sales
from tidemark.plans.dashboard import dashboard_payload
from tidemark.sources.warehouse import activity_view
from tidemark.operators import forecast as fc
from tidemark.operators import grouped_training as grp
from tidemark.operators import training as trn
from tidemark.plans.forecasting import forecast_run
from tidemark.functions.calendar import calendar_features
from tidemark.schema import FEATURE_COLS
from tidemark.session import materialize
from tidemark.sources.warehouse import (ORDER_TABLES, datasets_view, sales_table, snapshot,
                                        stored_table)

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def r2(c: str, places: int = 2):
    return round_half_up(c, places).alias(c)


# --- AGG1-4, AGG6 ----------------------------------------------------------

def _breakdown(spark, sf_dir, column):
    b = agg.breakdown(sales_table(spark, sf_dir), column)
    return b.select("dataset_id", "label", r2("revenue"), r2("units"), "share_pct")


@register("breakdown_category")
def breakdown_category(spark, sf_dir):
    return _breakdown(spark, sf_dir, "category")


@register("breakdown_region")
def breakdown_region(spark, sf_dir):
    return _breakdown(spark, sf_dir, "region")


@register("breakdown_product")
def breakdown_product(spark, sf_dir):
    return _breakdown(spark, sf_dir, "product")


@register("top_products")
def top_products(spark, sf_dir):
    b = agg.top_k(agg.breakdown(sales_table(spark, sf_dir), "product"), 10)
    return b.select("dataset_id", "rank", "label", r2("revenue"), r2("units"), "share_pct")


def _trend(spark, sf_dir, freq):
    t = agg.revenue_trend(sales_table(spark, sf_dir), freq)
    return t.select("dataset_id", "period", r2("revenue"), r2("units"))


@register("trend_daily")
def trend_daily(spark, sf_dir):
    return _trend(spark, sf_dir, "D")


@register("trend_weekly")
def trend_weekly(spark, sf_dir):
    return _trend(spark, sf_dir, "W")


@register("trend_monthly")
def trend_monthly(spark, sf_dir):
    return _trend(spark, sf_dir, "ME")


@register("overview")
def overview(spark, sf_dir):
    return agg.overview(datasets_view(spark, sf_dir), sales_table(spark, sf_dir))


@register("daily_series")
def daily_series(spark, sf_dir):
    d = agg.daily_revenue(sales_table(spark, sf_dir), keys=["dataset_id", "region"])
    return d.select("dataset_id", "region", "order_date", r2("revenue"), r2("quantity"))


# --- KPI0-13 ---------------------------------------------------------------

SALES_TARGET = 50_000_000.0


@register("kpi_summary")
def kpi_summary(spark, sf_dir):
    return kpi.compute_kpis(sales_table(spark, sf_dir), catalog=datasets_view(spark, sf_dir))


@register("kpi_mom_yoy")
def kpi_mom_yoy(spark, sf_dir):
    return kpi.period_growth(sales_table(spark, sf_dir), ["dataset_id", "region", "category"])


@register("kpi_top_entities")
def kpi_top_entities(spark, sf_dir):
    s = sales_table(spark, sf_dir)
    keys = ["dataset_id", "region"]
    return (kpi.top_entity(s, "product", keys)
            .join(kpi.top_entity(s, "category", keys), keys, "left"))


@register("kpi_target")
def kpi_target(spark, sf_dir):
    k = kpi.compute_kpis(sales_table(spark, sf_dir), sales_target=SALES_TARGET)
    return k.select("dataset_id", "total_revenue", "sales_target_achievement_pct")


# --- DT1, WIN1-7, FEA1 -----------------------------------------------------

SERIES_KEYS = ["dataset_id", "region"]


def series_daily(spark, sf_dir):
    return agg.daily_revenue(sales_table(spark, sf_dir), keys=SERIES_KEYS)


@register("calendar_features")
def calendar_features_q(spark, sf_dir):
    d = series_daily(spark, sf_dir)
    return d.select(*SERIES_KEYS, "order_date", *calendar_features("order_date"))


@register("lag_features")
def lag_features_q(spark, sf_dir):
    d = series_daily(spark, sf_dir)
    lags = d.select(*SERIES_KEYS, "order_date", *fe.lag_features(SERIES_KEYS))
    return lags.select(*SERIES_KEYS, "order_date",
                       *[r2(c) for c in lags.columns if "lag" in c])


@register("rolling_features")
def rolling_features_q(spark, sf_dir):
    d = series_daily(spark, sf_dir)
    roll = d.select(*SERIES_KEYS, "order_date", *fe.rolling_features(SERIES_KEYS))
    return roll.select(*SERIES_KEYS, "order_date",
                       *[r2(c, 4) for c in roll.columns if "roll" in c])


@register("feature_matrix")
def feature_matrix_q(spark, sf_dir):
    f = fe.build_features(series_daily(spark, sf_dir), SERIES_KEYS)
    dbl = {"revenue", "quantity"} | {c for c in FEATURE_COLS if "lag" in c or "roll" in c}
    return f.select(*SERIES_KEYS, "order_date",
                    *[r2(c, 4) if c in dbl else F.col(c) for c in ["revenue", "quantity"] + FEATURE_COLS])


@register("chrono_split")
def chrono_split_q(spark, sf_dir):
    f = fe.build_features(series_daily(spark, sf_dir), SERIES_KEYS)
    s = fe.chrono_split(f, SERIES_KEYS, test_size=0.2)
    return s.select(*SERIES_KEYS, "order_date", "is_train")


# --- EVL1-4, MOD1-5 (seasonal-naive runs) ---------------------------------------

METRICS = ["mae", "rmse", "mape", "r2"]


def dataset_features(spark, sf_dir):
    daily = agg.daily_revenue(sales_table(spark, sf_dir), keys=["dataset_id"])
    return fe.build_features(daily, ["dataset_id"])


def registry_rows(spark, sf_dir):
    """The seasonal-naive registry, stored once per data snapshot like the
    model table it stands for; every read path queries the stored rows."""
    return stored_table(spark, sf_dir, "naive_registry",
                        lambda sp, d: baselines.naive_registry(dataset_features(sp, d),
                                                               ["dataset_id"]),
                        partition_by=None)


def _registry_out(df):
    return df.select("dataset_id", "model_id", "algorithm", "version", "file_path", "status",
                     *[r2(m, 4) for m in METRICS], "hyperparameters", "is_active", "trained_at")


@register("eval_metrics")
def eval_metrics(spark, sf_dir):
    f = materialize(fe.build_features(series_daily(spark, sf_dir), SERIES_KEYS))
    m = baselines.naive_run_metrics(f, SERIES_KEYS, 0.2)
    return m.select(*SERIES_KEYS, "algorithm", *[r2(c, 4) for c in METRICS])


@register("confidence_score")
def confidence_score(spark, sf_dir):
    m = baselines.naive_run_metrics(dataset_features(spark, sf_dir), ["dataset_id"], 0.2)
    m = evl.with_confidence(m)
    return m.select("dataset_id", "algorithm", r2("mape", 4), "confidence_score")


@register("pick_best")
def pick_best_q(spark, sf_dir):
    return _registry_out(registry_rows(spark, sf_dir))


@register("compare_models")
def compare_models_q(spark, sf_dir):
    return _registry_out(sel.compare_models(sel.current_active(registry_rows(spark, sf_dir))))


@register("resolve_model")
def resolve_model_q(spark, sf_dir):
    return _registry_out(sel.resolve_model(registry_rows(spark, sf_dir)))


@register("resolve_model_named")
def resolve_model_named_q(spark, sf_dir):
    return _registry_out(sel.resolve_model(registry_rows(spark, sf_dir), algorithm="naive_lag_7"))


# --- FCT3, FCT6, KPI11/JON3 on the seasonal-naive registry ------------------------

HORIZON = 30


@register("forecast_band")
def forecast_band_q(spark, sf_dir):
    """Active model per dataset forecast 30 days, with band and confidence."""
    daily = materialize(agg.daily_revenue(sales_table(spark, sf_dir), ["dataset_id"]))
    active = sel.resolve_model(registry_rows(spark, sf_dir)).cache()
    parts = []
    for k in baselines.NAIVE_LAGS:
        m = active.where(F.col("algorithm") == f"naive_lag_{k}")
        pts = baselines.naive_forecast(daily.join(m.select("dataset_id"), "dataset_id", "left_semi"),
                                       ["dataset_id"], k, HORIZON)
        parts.append(fc.tree_band(pts, m, ["dataset_id"], ["dataset_id"]))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return fc.response_points(out, ["dataset_id"])


@register("kpi_forecast_accuracy")
def kpi_forecast_accuracy_q(spark, sf_dir):
    active = sel.resolve_model(registry_rows(spark, sf_dir))
    k = kpi.compute_kpis(sales_table(spark, sf_dir), active_models=active)
    return k.select("dataset_id", "total_revenue", "forecast_accuracy_pct")


# --- TRN1-9, FCT2/4/5 (rows-only: learned models) ---------------------------------

_RUNS: dict = {}


def _train(spark, sf_dir, algorithms, tune=False, pooled=False):
    """A training run of the shared tables, all datasets in a fixed number of
    jobs; queries that ask for the same run of the same files in the same
    session get the one already made."""
    key = (spark.sparkContext.applicationId, snapshot(spark, sf_dir, ORDER_TABLES),
           tuple(algorithms), tune, pooled)
    if key not in _RUNS:
        sales = sales_table(spark, sf_dir)
        _RUNS[key] = (trn.train_and_compare(sales, ["dataset_id"], algorithms, test_size=0.2, tune=tune, pooled=True) if pooled
                      else grp.train_grouped(sales, ["dataset_id"], algorithms, test_size=0.2, tune=tune))
    return _RUNS[key]


def _metrics_out(run):
    return run.registry.select("dataset_id", "algorithm", "implementation",
                               *[r2(m, 4) for m in METRICS], "is_active")


def _tuned_out(run):
    return run.registry.select("dataset_id", "algorithm", "hyperparameters",
                               *[r2(m, 4) for m in METRICS], "is_active")


@register("train_gbt")
def train_gbt(spark, sf_dir):
    return _metrics_out(_train(spark, sf_dir, ["gradient_boosting"]))


@register("train_rf")
def train_rf(spark, sf_dir):
    return _metrics_out(_train(spark, sf_dir, ["random_forest"]))


@register("train_compare")
def train_compare(spark, sf_dir):
    """All five algorithms for every dataset, compared on the test split."""
    return _metrics_out(_train(spark, sf_dir, trn.AVAILABLE_ALGORITHMS))


@register("train_pooled")
def train_pooled(spark, sf_dir):
    """One GBT over every dataset's panel (dataset index as a feature)."""
    return _metrics_out(_train(spark, sf_dir, ["gradient_boosting"], pooled=True))


@register("tune_cv")
def tune_cv(spark, sf_dir):
    """Random search with three contiguous folds, per dataset."""
    return _tuned_out(_train(spark, sf_dir, ["gradient_boosting"], tune=True))


@register("tune_cv_forest")
def tune_cv_forest(spark, sf_dir):
    return _tuned_out(_train(spark, sf_dir, ["random_forest"], tune=True))


@register("tune_cv_xgboost")
def tune_cv_xgboost(spark, sf_dir):
    return _tuned_out(_train(spark, sf_dir, ["xgboost"], tune=True))


@register("tune_cv_lightgbm")
def tune_cv_lightgbm(spark, sf_dir):
    return _tuned_out(_train(spark, sf_dir, ["lightgbm"], tune=True))


@register("forecast_recursive")
def forecast_recursive(spark, sf_dir):
    sales = sales_table(spark, sf_dir)
    run = _train(spark, sf_dir, ["gradient_boosting"])
    return fc.response_points(forecast_run(run, sales, HORIZON), ["dataset_id", "algorithm"])


@register("forecast_segment")
def forecast_segment(spark, sf_dir):
    """Dataset-level models applied to every region segment at once."""
    sales = sales_table(spark, sf_dir)
    run = _train(spark, sf_dir, ["gradient_boosting"])
    out = forecast_run(run, sales, HORIZON, segment_keys=["region"])
    return fc.response_points(out, ["dataset_id", "region", "algorithm"])


@register("forecast_additive")
def forecast_additive(spark, sf_dir):
    sales = sales_table(spark, sf_dir)
    run = _train(spark, sf_dir, ["prophet"])
    return fc.response_points(forecast_run(run, sales, HORIZON), ["dataset_id", "algorithm"])


# --- ING1-14 on uploads derived from the tables ----------------------------------

CLEAN_COLS = ["dataset_id", "order_date", "product", "category", "region"]


def _clean_out(clean):
    return clean.select(*CLEAN_COLS, r2("quantity"), r2("unit_price"), r2("revenue"), "cost")


def _report_out(report):
    return report.select("dataset_id", "is_valid", "total_rows", "valid_rows", "invalid_rows",
                         F.array_join("warnings", " | ").alias("warnings"),
                         F.size("errors").cast("bigint").alias("n_errors"))


@register("ingest_clean")
def ingest_clean(spark, sf_dir):
    clean, _ = ingest.validate_and_clean(uploads.dirty_upload_table(spark, sf_dir))
    return _clean_out(clean)


@register("ingest_report")
def ingest_report(spark, sf_dir):
    _, report = ingest.validate_and_clean(uploads.dirty_upload_table(spark, sf_dir))
    return _report_out(report)


@register("derive_revenue")
def derive_revenue(spark, sf_dir):
    """ING8-10 audit: rows and revenue per dataset by the rule that set it."""
    clean, _ = ingest.validate_and_clean(uploads.dirty_upload_table(spark, sf_dir),
                                         with_source=True)
    g = clean.groupBy("dataset_id", "revenue_source").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.sum("revenue").alias("revenue"))
    return g.select("dataset_id", "revenue_source", "rows", r2("revenue"))


@register("ingest_fallback")
def ingest_fallback(spark, sf_dir):
    clean, _ = ingest.validate_and_clean(uploads.fallback_upload_table(spark, sf_dir))
    return _clean_out(clean)


@register("ingest_fallback_report")
def ingest_fallback_report(spark, sf_dir):
    _, report = ingest.validate_and_clean(uploads.fallback_upload_table(spark, sf_dir))
    return _report_out(report)


# --- SRC4, SRT1-3, JON4/SNK7, JSN1, AGG5 ------------------------------------------

@register("owner_filter")
def owner_filter(spark, sf_dir):
    """Datasets a non-admin user 1 sees, newest first."""
    return act.visible_datasets(datasets_view(spark, sf_dir), user_id=1, is_admin=False)


@register("recent_activity_user")
def recent_activity_user(spark, sf_dir):
    """Every user's own last 200 activity rows, newest first (per-user top-k)."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("event_id").desc())
    a = activity_view(spark, sf_dir)
    return (a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 200)
            .select("user_id", "rank", "event_id", "action", "details", "created_at"))


@register("recent_activity_all")
def recent_activity_all(spark, sf_dir):
    return act.recent_activity(activity_view(spark, sf_dir)).select(
        "user_id", "event_id", "action", "details", "ip_address", "created_at")


@register("latest_activity")
def latest_activity_q(spark, sf_dir):
    """SRT2 over the log stored by day: only the newest days are read."""
    log = stored_table(spark, sf_dir, "activity_days",
                       lambda sp, d: activity_view(sp, d).withColumn("day", F.to_date("created_at")).repartition("day"),
                       sources=("events",), partition_by="day")
    return act.latest_activity(log).select("user_id", "event_id", "action", "details", "ip_address", "created_at")


@register("cascade_delete")
def cascade_delete_q(spark, sf_dir):
    """Delete user 1's datasets: the sales and models that remain."""
    gone = datasets_view(spark, sf_dir).where(F.col("owner_id") == 1).select("dataset_id")
    sales = cascade_delete(sales_table(spark, sf_dir), gone)
    left = sales.groupBy("dataset_id").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                           F.sum("revenue").alias("revenue"))
    return left.select("dataset_id", "rows", r2("revenue"))


@register("json_roundtrip")
def json_roundtrip(spark, sf_dir):
    _, report = ingest.validate_and_clean(uploads.dirty_upload_table(spark, sf_dir))
    back = act.report_from_json(act.report_to_json(report))
    return back.select("dataset_id", "is_valid", "total_rows", "valid_rows", "invalid_rows",
                       F.size("warnings").cast("bigint").alias("n_warnings"),
                       F.col("detected_columns")["revenue"].alias("revenue_source"),
                       F.col("detected_columns")["quantity"].alias("quantity_source"))


@register("dashboard_payload")
def dashboard_payload_q(spark, sf_dir):
    return dashboard_payload(sales_table(spark, sf_dir), "ME")


# --- SRC6, SRC3, FCT1, AGG5 ---------------------------------------------------

@register("stream_ingest")
def stream_ingest(spark, sf_dir):
    """Each segment of the dirty uploads lands as a folder of several CSV
    files; the stream ingests every folder as a dataset; per dataset: status,
    rows, revenue."""
    import uuid

    from tidemark.session import shared_path
    from tidemark.sinks.store import Store
    from tidemark.streaming.file_ingest import start_file_ingest

    root = shared_path(spark, "stream_ingest", uuid.uuid4().hex)
    landing = f"{root}/landing"
    raw = uploads.dirty_upload_table(spark, sf_dir)
    # ranges of (dataset, row): a large upload is many files, in row order by name
    (raw.repartitionByRange("dataset_id", "_row").sortWithinPartitions("dataset_id", "_row").drop("_row")
     .write.partitionBy("dataset_id").option("header", True).csv(f"{root}/staged"))
    # each dataset's folder is moved into the landing folder
    hadoop = spark._jvm.org.apache.hadoop.fs
    staged = hadoop.Path(f"{root}/staged")
    fs = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(landing))
    for folder in fs.listStatus(staged):
        name = folder.getPath().getName()
        if name.startswith("dataset_id="):
            fs.rename(folder.getPath(), hadoop.Path(f"{landing}/{name.split('=', 1)[1].lower()}"))
    store = Store(spark, f"{root}/store")
    q = start_file_ingest(spark, landing, store, f"{root}/checkpoint")
    q.awaitTermination()
    cat = store.datasets().select("dataset_id", "original_filename", "status", "row_count")
    sales = store.read("sales").groupBy("dataset_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("stored_rows"),
        F.sum("revenue").alias("revenue"))
    return (cat.join(sales, "dataset_id", "left")
            .select(F.col("original_filename").alias("segment"),
                    "status", "row_count", "stored_rows", r2("revenue")))


@register("sales_scan")
def sales_scan(spark, sf_dir):
    """SRC3/FCT1: the sales rows of one dataset and region, as a forecast of
    that segment reads them (partition pruned, filter pushed)."""
    rows = select_sales(sales_table(spark, sf_dir), "BUILDING", region="ASIA")
    return rows.select("dataset_id", "order_date", "product", "category", "region", r2("quantity"), r2("unit_price"), r2("revenue"))


@register("segment_daily")
def segment_daily_q(spark, sf_dir):
    """FCT1: the daily series of every segment - each category and region,
    alone, together and over all - labelled as predictions are."""
    d = agg.segment_daily(sales_table(spark, sf_dir))
    return d.select("dataset_id", "segment", "order_date", r2("revenue"), r2("quantity"))


@register("dashboard_sections")
def dashboard_sections(spark, sf_dir):
    """AGG5: the payload's trend and breakdowns, one row an entry."""
    d = materialize(dashboard_payload(sales_table(spark, sf_dir), "ME"))
    parts = [d.select("dataset_id", F.lit("revenue_trend").alias("section"), F.explode("revenue_trend").alias("e"))
             .select("dataset_id", "section", F.col("e.period").cast("string").alias("label"), "e.revenue", "e.units",
                     F.lit(None).cast("double").alias("share_pct"))]
    parts += [d.select("dataset_id", F.lit(c).alias("section"), F.explode(c).alias("e"))
              .select("dataset_id", "section", "e.label", "e.revenue", "e.units", "e.share_pct") for c in ("by_category", "by_region", "by_product")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.select("dataset_id", "section", "label", r2("revenue"), r2("units"), "share_pct")


@register("daily_ffill")
def daily_ffill(spark, sf_dir):
    """FIL1: per (segment, region) day, missing days carry the last value."""
    d = agg.daily_revenue(sales_table(spark, sf_dir), keys=SERIES_KEYS, fill=None)
    f = fe.forward_fill(d, SERIES_KEYS, ["revenue", "quantity"])
    return f.select(*SERIES_KEYS, "order_date", r2("revenue"), r2("quantity"))
