"""Service flow over a store: upload -> train -> predict -> delete."""
import pytest
from pyspark.sql import functions as F

from conftest import F1_HEADER, f2_rows
from tidemark.plans import workflow as wf
from tidemark.sinks.store import Store


@pytest.fixture(scope="module")
def env(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    store = Store(spark, str(root / "tables"))
    good = root / "sixty_days.csv"
    good.write_text("\n".join([F1_HEADER] + f2_rows()) + "\n")
    bad = root / "no_date.csv"
    bad.write_text("A,B\n1,2\n")
    rep = wf.upload(spark, store, str(good), owner_id=7).first()
    bad_rep = wf.upload(spark, store, str(bad), owner_id=7).first()
    return store, rep, bad_rep


def test_upload_catalogue(env):
    store, rep, bad_rep = env
    assert rep.is_valid and rep.valid_rows == 60
    assert not bad_rep.is_valid
    cat = {r.status: r for r in store.datasets().collect()}
    assert cat["processed"].row_count == 60 and cat["invalid"].row_count == 0
    assert store.sales(rep.dataset_id).count() == 60
    assert store.read("sales").select("dataset_id").distinct().count() == 1   # SNK2: no rows
    k = wf.kpi_summary(store, rep.dataset_id).first()
    assert k.total_orders == 60 and k.total_revenue > 0


def test_train_predict_delete(spark, env):
    store, rep, _ = env
    ds = rep.dataset_id
    wf.train(store, ds, ["gradient_boosting", "random_forest"])
    models = store.models().collect()
    assert len(models) == 2 and sum(m.is_active for m in models) == 1
    pts = wf.predict(spark, store, ds, horizon=7).collect()
    assert len(pts) == 7
    active = [m for m in models if m.is_active][0]
    assert pts[0].evaluation.mae == active.mae and pts[0].horizon_days == 7
    assert all(p.lower_bound <= p.predicted_revenue <= p.upper_bound for p in pts)
    preds = store.predictions().collect()
    assert len(preds) == 7 and {p.segment for p in preds} == {"category=all;region=all"}
    seg = wf.predict(spark, store, ds, horizon=3, region="North").collect()
    assert len(seg) == 3
    assert {r.action for r in store.activity().collect()} >= {"dataset_upload", "model_train",
                                                               "forecast_predict"}
    k = wf.kpi_summary(store, ds).first()
    assert k.forecast_accuracy_pct is not None
    with pytest.raises(PermissionError):
        wf.delete_dataset(store, ds, user_id=1, is_admin=False)
    wf.delete_dataset(store, ds, user_id=7, is_admin=False)
    assert store.sales(ds).count() == 0
    assert store.models().where(F.col("dataset_id") == ds).count() == 0
    assert store.predictions().count() == 0
    with pytest.raises(LookupError):
        wf.delete_dataset(store, ds, user_id=7, is_admin=False)


def _dataset(spark, store, name, level, days, owner=7):
    """An upload of ``days`` daily rows around ``level``."""
    import datetime as dt
    p = store.root + f"-{name}.csv"
    rows = [f"{(dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat()},P,C,{'N' if i < days - 5 else 'S'},1,"
            f"{level},{level * (1 + i % 7 / 10)}" for i in range(days)]
    with open(p, "w") as f:
        f.write("\n".join([F1_HEADER, *rows]) + "\n")
    return p, wf.upload(spark, store, p, owner_id=owner).first().dataset_id


def test_retrain_sees_new_rows_and_replay_keeps_one_row(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    path, ds = _dataset(spark, store, "a sales", 100.0, 70)
    wf.train(store, ds, ["gradient_boosting"])
    with open(path) as f:
        text = f.read().replace("100.0,", "100000.0,").splitlines()
    with open(path, "w") as f:
        f.write("\n".join([text[0]] + [",".join([*x.split(",")[:-1], str(float(x.split(",")[-1]) * 1000)]) for x in text[1:]]))
    wf.upload(spark, store, path, owner_id=7)
    assert store.datasets().where(F.col("dataset_id") == ds).count() == 1
    wf.train(store, ds, ["gradient_boosting"])
    mae = [r.mae for r in store.models().orderBy("trained_at").collect()]
    assert mae[1] > 100 * mae[0]
    short = wf.predict(spark, store, ds, horizon=3, region="S").collect()
    assert len(short) == 1 and "days of history" in short[0].error
    with pytest.raises(LookupError):
        wf.train(store, ds + 1, ["gradient_boosting"])
    with pytest.raises(PermissionError):
        wf.train(store, ds, ["gradient_boosting"], owner_id=8)
    with pytest.raises(LookupError):
        wf.kpi_summary(store, ds + 1)


def test_delete_touches_no_other_dataset(spark, tmp_path):
    import os
    store = Store(spark, str(tmp_path / "tables"))
    path, one = _dataset(spark, store, "one", 10.0, 5)
    _, two = _dataset(spark, store, "two", 20.0, 5)
    kept = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{store.root}/sales/dataset_id={two}") for f in fs}
    wf.delete_dataset(store, one, user_id=7, is_admin=False)
    after = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{store.root}/sales/dataset_id={two}") for f in fs}
    assert kept == after and not os.path.exists(path)
    assert [r.dataset_id for r in store.datasets().collect()] == [two]


def test_model_folders_and_key_types(spark):
    from tidemark.operators.training import model_folder
    names = {model_folder([k]) for k in ("A B", "A_B", "A#1", "A/1", "01", "1", "é")}
    assert len(names) == 7 and all(n.replace("-", "").isalnum() and n.isascii() for n in names)


def test_string_keys_forecast(spark):
    import datetime as dt
    from tidemark.operators.training import train_and_compare
    from tidemark.plans.forecasting import forecast_run
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), "P", "C", "N", 1.0, level * (1 + i % 7 / 10))
            for k, level in (("A B", 100.0), ("A_B", 100000.0), ("A#1", 10.0), ("01", 5.0), ("1", 500.0)) for i in range(50)]
    sales = spark.createDataFrame(rows, "dataset_id string, order_date date, product string, category string, "
                                        "region string, quantity double, revenue double")
    run = train_and_compare(sales, ["dataset_id"], ["gradient_boosting"])
    out = forecast_run(run, sales, 2).collect()
    assert sorted((r.dataset_id, r.step) for r in out) == sorted((k, s) for k in ("A B", "A_B", "A#1", "01", "1") for s in (1, 2))
    level = {r.dataset_id: r.predicted_revenue for r in out if r.step == 1}
    assert level["A_B"] > 50000 and level["A B"] < 500 and level["01"] < 20 < level["1"]


def test_stream_takes_odd_names_and_empty_files(spark, tmp_path):
    from tidemark.streaming.file_ingest import start_file_ingest
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "jan sales#1.csv").write_text("Date,Revenue\n2024-01-01,5\n")
    (landing / "empty.csv").write_text("")
    (landing / "header.csv").write_text("Date,Revenue\n")
    store = Store(spark, str(tmp_path / "tables"))
    start_file_ingest(spark, str(landing), store, str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.original_filename: (r.status, r.row_count) for r in store.datasets().collect()}
    assert got == {"jan sales#1.csv": ("processed", 1), "empty.csv": ("invalid", 0), "header.csv": ("invalid", 0)}
