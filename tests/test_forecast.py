import datetime as dt

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from conftest import F1_HEADER, f2_rows, upload
from tidemark.operators import aggregates as agg
from tidemark.operators import features as fe
from tidemark.operators import forecast as fc
from tidemark.operators.ingest import validate_and_clean
from tidemark.operators.selection import list_algorithms, new_version
from tidemark.operators.training import train_and_compare
from tidemark.plans.forecasting import forecast_run
from tidemark.schema import FEATURE_COLS


@pytest.fixture(scope="module")
def f2(spark, tmp_path_factory):
    clean, _ = validate_and_clean(upload(spark, tmp_path_factory.mktemp("f2"), "f2.csv",
                                         F1_HEADER, f2_rows()))
    return clean.cache()


@pytest.fixture(scope="module")
def run(f2):
    return train_and_compare(f2, ["dataset_id"], ["gradient_boosting", "random_forest"])


def test_train_flow(run):
    rows = run.registry.collect()
    assert {r.algorithm for r in rows} == {"gradient_boosting", "random_forest"}
    assert sum(r.is_active for r in rows) == 1
    best = min(rows, key=lambda r: r.mae)
    assert best.is_active
    assert run.errors.count() == 0


def test_forecast_seven_points(run, f2):
    pts = forecast_run(run, f2, horizon=7).orderBy("step").collect()
    assert len(pts) == 7
    assert pts[0].target_date == dt.date(2024, 3, 1)
    for p in pts:
        assert 0.0 <= p.lower_bound <= p.predicted_revenue <= p.upper_bound


def test_recursion_matches_transform(spark, run, f2):
    gbt = [r for r in run.registry.collect() if r.algorithm == "gradient_boosting"][0]
    fake = run.registry.where("algorithm = 'gradient_boosting'").withColumn("is_active", F.lit(True))
    run2 = type(run)(**{**run.__dict__, "registry": fake})
    step1 = forecast_run(run2, f2, horizon=1).first().predicted_revenue
    daily = agg.daily_revenue(f2)
    nxt = spark.createDataFrame([(1, dt.date(2024, 3, 1), None, None)],
                                "dataset_id bigint, order_date date, revenue double, quantity double")
    feats = fe.build_features(daily.unionByName(nxt), drop_warmup=False)
    x = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features").transform(
        feats.where(F.col("order_date") == dt.date(2024, 3, 1)))
    ref = GBTRegressionModel.load(gbt.file_path).transform(x).first().prediction
    assert abs(step1 - max(ref, 0.0)) < 1e-6


def test_band_fallback_without_rmse(spark):
    pts = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1), 0.0), (1, 2, dt.date(2024, 1, 2), 0.0)],
                                "dataset_id bigint, step int, target_date date, predicted_revenue double")
    models = spark.createDataFrame([(1, 0.0, None)], "dataset_id bigint, rmse double, mape double")
    b = fc.tree_band(pts, models, ["dataset_id"], ["dataset_id"]).orderBy("step").collect()
    assert [round(r.upper_bound, 6) for r in b] == [1.0, round(2 ** 0.5, 6)]
    assert all(r.confidence_score == 0.5 and r.lower_bound == 0.0 for r in b)


def test_horizon_and_registry_helpers():
    with pytest.raises(ValueError):
        fc.check_horizon(0)
    with pytest.raises(ValueError):
        fc.check_horizon(366)
    assert len(new_version()) == 21
    assert list_algorithms() == ["gradient_boosting", "random_forest", "xgboost", "lightgbm",
                                 "prophet"]


def test_guards_refuse_short_history(spark, f2):
    short = f2.where(F.col("order_date") < dt.date(2024, 1, 11)).withColumn(
        "dataset_id", F.lit(2).cast("bigint"))
    run = train_and_compare(f2.unionByName(short), ["dataset_id"], ["prophet"])
    errs = {r.dataset_id: r.error for r in run.errors.collect()}
    assert list(errs) == [2] and "Not enough historical data" in errs[2]
    assert {r.dataset_id for r in run.registry.collect()} == {1}


def test_additive_forecast_matches_transform(spark, f2):
    import json
    from pyspark.ml.regression import LinearRegressionModel
    from tidemark.operators.training import additive_term_names, additive_terms
    run = train_and_compare(f2, ["dataset_id"], ["prophet"])
    row = run.registry.collect()[0]
    pts = forecast_run(run, f2, horizon=5).orderBy("step").collect()
    assert [p.target_date for p in pts] == [dt.date(2024, 3, 1) + dt.timedelta(days=i)
                                             for i in range(5)]
    cps = json.loads(row.hyperparameters)["changepoints"]
    fut = spark.createDataFrame([(dt.date(2024, 3, 1) + dt.timedelta(days=i), float(60 + i))
                                 for i in range(5)], "d date, t double")
    design = VectorAssembler(inputCols=additive_term_names(len(cps)), outputCol="features") \
        .transform(fut.select("d", *additive_terms("d", "t", cps)))
    ref = [max(r.prediction, 0.0) for r in
           LinearRegressionModel.load(row.file_path).transform(design).orderBy("d").collect()]
    assert max(abs(p.predicted_revenue - r) for p, r in zip(pts, ref)) < 1e-6
    assert all(p.lower_bound <= p.predicted_revenue <= p.upper_bound for p in pts)


def test_pooled_model_forecast_matches_transform(spark, f2):
    two = f2.unionByName(f2.withColumn("dataset_id", F.lit(2).cast("bigint"))
                         .withColumn("revenue", F.col("revenue") * 2))
    run = train_and_compare(two, ["dataset_id"], ["gradient_boosting"], pooled=True)
    reg = run.registry.collect()
    assert len(reg) == 2 and len({r.file_path for r in reg}) == 1
    assert len({r.series_index for r in reg}) == 2
    pts = forecast_run(run, two, horizon=3).where("step = 1").collect()
    assert len(pts) == 2
    daily = agg.daily_revenue(two)
    nxt = spark.createDataFrame([(k, dt.date(2024, 3, 1), None, None) for k in (1, 2)],
                                "dataset_id bigint, order_date date, revenue double, quantity double")
    feats = fe.build_features(daily.unionByName(nxt), drop_warmup=False) \
        .where(F.col("order_date") == dt.date(2024, 3, 1))
    idx = {r.dataset_id: r.series_index for r in reg}
    feats = feats.join(spark.createDataFrame(list(idx.items()), "dataset_id bigint, series_index double"),
                       "dataset_id")
    x = VectorAssembler(inputCols=FEATURE_COLS + ["series_index"], outputCol="features").transform(feats)
    ref = {r.dataset_id: max(r.prediction, 0.0)
           for r in GBTRegressionModel.load(reg[0].file_path).transform(x).collect()}
    for p in pts:
        assert abs(p.predicted_revenue - ref[p.dataset_id]) < 1e-6
