"""The reference's service flows as Spark jobs over a ``Store``.

upload -> validate/clean -> store rows + catalogue (SRC1-2, ING*, SNK1-2, SNK6)
train  -> compare -> append registry rows (TRN*, MOD1, MOD4, SNK4-6)
predict-> resolve model -> forecast -> append predictions (MOD3, FCT*, SNK3, SNK6)
kpis / dashboard / overview over stored rows (SRC3-4, KPI*, AGG*)
delete -> cascade over sales, models, predictions (SRC5, SNK7)

Each step reads and writes whole tables through Spark; the driver only sees
ids, statuses and counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import activity as act
from tidemark.operators import forecast as fc
from tidemark.operators import kpi
from tidemark.operators.grouped_training import train_grouped
from tidemark.operators.selection import current_active, resolve_model
from tidemark.operators.training import TrainingRun, train_and_compare
from tidemark.plans.dashboard import dashboard_payload
from tidemark.plans.forecasting import forecast_run
from tidemark.schema import AVAILABLE_ALGORITHMS
from tidemark.sinks.store import Store
from tidemark.streaming.file_ingest import ingest_file

REGISTRY_COLUMNS = ["dataset_id", "model_id", "algorithm", "version", "file_path", "status",
                    "mae", "rmse", "mape", "r2", "hyperparameters", "is_active", "trained_at",
                    "kind", "implementation", "series_index"]


def upload(spark: SparkSession, store: Store, path: str, owner_id: int = 1) -> DataFrame:
    """POST /datasets/upload: returns the validation report row."""
    return ingest_file(spark, path, store, owner_id)


def _known(store: Store, dataset_id, owner_id: int | None = None, is_admin: bool = False) -> None:
    """The dataset exists and, where an owner is named, is theirs."""
    rows = store.datasets().where(F.col("dataset_id") == F.lit(dataset_id))
    found = rows.select("owner_id").first()
    if found is None:
        raise LookupError(f"dataset {dataset_id} is not in the catalogue")
    if owner_id is not None and not is_admin and found["owner_id"] != owner_id:
        raise PermissionError(f"dataset {dataset_id} belongs to another user")


def train(store: Store, dataset_id, algorithms, test_size: float = 0.2, tune: bool = False,
          user_id: int = 1, owner_id: int | None = None, is_admin: bool = False) -> TrainingRun:
    """POST /forecast/train: fit, compare and append the run's models;
    ``owner_id`` asks for an ownership check."""
    _known(store, dataset_id, owner_id, is_admin)
    sales = store.sales(dataset_id)
    if sales.limit(1).count() == 0:
        raise ValueError("No sales rows are stored for this dataset.")
    run = train_and_compare(sales, ["dataset_id"], algorithms, test_size=test_size, tune=tune)
    if run.registry is None:
        raise RuntimeError("every fit failed or was refused; see the run's errors")
    store.append_models(run.registry.select(*REGISTRY_COLUMNS))
    store.log_activity(user_id, "model_train",
                       {"dataset_id": int(dataset_id), "algorithms": list(algorithms)})
    return run


def retrain(store: Store, algorithms: Sequence[str] = AVAILABLE_ALGORITHMS, test_size: float = 0.2, tune: bool = False,
            user_id: int = 1) -> TrainingRun:
    """The scheduled job (TRN9): every processed dataset of the store trained
    and compared in one run; its models are appended.  Datasets that are
    refused are in the run's errors."""
    active = store.datasets().where(F.col("status") == "processed").select("dataset_id")
    sales = store.sales().join(active, "dataset_id", "left_semi")
    run = train_grouped(sales, ["dataset_id"], algorithms, test_size=test_size, tune=tune, model_root=f"{store.root.rstrip('/')}/model_nodes")
    if run.registry is not None:
        store.append_models(run.registry.select(*REGISTRY_COLUMNS))
    store.log_activity(user_id, "model_train", {"dataset_id": "all", "algorithms": list(algorithms)})
    return run


def predict(spark: SparkSession, store: Store, dataset_id, horizon: int = 30,
            algorithm: str | None = None, category: str | None = None,
            region: str | None = None, user_id: int = 1) -> DataFrame:
    """POST /forecast/predict: resolve the model from the stored registry,
    forecast the (optionally filtered) series, append the predictions and
    return the response points."""
    fc.check_horizon(horizon)
    registry = store.models().where(F.col("dataset_id") == F.lit(dataset_id))
    chosen = resolve_model(current_active(registry), ["dataset_id"], algorithm)
    if chosen.limit(1).count() == 0:
        raise LookupError("no model is registered for this dataset; train one first")
    sales = fc.segment_filter(store.sales(dataset_id), category, region)
    if sales.limit(1).count() == 0:
        raise ValueError("the filters leave no sales rows")
    run = TrainingRun(version="", registry=chosen.withColumn("is_active", F.lit(True)),
                      errors=None, panel_path="", daily_path="", keys=["dataset_id"])
    points = forecast_run(run, sales, horizon).cache()
    try:
        records = fc.prediction_records(points, "model_id", category, region)
        store.append_predictions(records)
        store.log_activity(user_id, "forecast_predict",
                           {"dataset_id": int(dataset_id), "horizon_days": horizon})
        evaluation = chosen.select("model_id", F.struct("mae", "rmse", "mape", "r2")
                                   .alias("evaluation"))
        resp = fc.response_points(points, ["dataset_id", "algorithm", "model_id"])
        resp = resp.join(evaluation, "model_id", "left").withColumn(
            "horizon_days", F.lit(horizon)).cache()
        resp.count()   # computed from the cached points before they are released
        return resp
    finally:
        points.unpersist()


def _active(store: Store, dataset_id):
    models = store.models().where(F.col("dataset_id") == F.lit(dataset_id))
    return resolve_model(models, ["dataset_id"], require_ready=False)


def kpi_summary(store: Store, dataset_id, sales_target: float | None = None) -> DataFrame:
    """GET /kpi/{id}/summary (KPI11 from the dataset's active model)."""
    _known(store, dataset_id)
    return kpi.compute_kpis(store.sales(dataset_id), ["dataset_id"], _active(store, dataset_id), sales_target,
                            catalog=store.datasets().where(F.col("dataset_id") == F.lit(dataset_id)))


def dashboard(store: Store, dataset_id, freq: str = "D", sales_target: float | None = None) -> DataFrame:
    """GET /kpi/{id}/dashboard, with the active model's accuracy and a target."""
    _known(store, dataset_id)
    return dashboard_payload(store.sales(dataset_id), freq, active_models=_active(store, dataset_id),
                             sales_target=sales_target)


def delete_dataset(store: Store, dataset_id, user_id: int, is_admin: bool) -> None:
    """DELETE /datasets/{id}: ownership check, then the cascade."""
    act.get_dataset(store.datasets(), dataset_id, user_id, is_admin)
    ids = store.spark.createDataFrame([(int(dataset_id),)], "dataset_id bigint")
    store.delete_datasets(ids)
