from pyspark.sql import functions as F

from conftest import F1_HEADER, f2_rows, upload
from tidemark.operators import aggregates as agg
from tidemark.operators import features as fe
from tidemark.operators.ingest import validate_and_clean
from tidemark.operators.metrics import evaluate, with_confidence
from tidemark.schema import FEATURE_COLS


def test_f2_features_and_split(spark, tmp_path):
    clean, _ = validate_and_clean(upload(spark, tmp_path, "f2.csv", F1_HEADER, f2_rows()))
    daily = agg.daily_revenue(clean)
    feats = fe.build_features(daily)
    assert feats.count() == 30
    assert feats.columns[-len(FEATURE_COLS):] == FEATURE_COLS
    split = fe.chrono_split(feats, test_size=0.2)
    assert split.where("is_train").count() == 24
    first = feats.orderBy("order_date").first()
    assert first.time_index == 30 and first.revenue_lag_7 == first.revenue


def test_e10_mape_mask(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 10.0, 8.0), (1, 20.0, 25.0)],
                               "k int, revenue double, prediction double")
    m = evaluate(df, ["k"]).first()
    assert abs(m.mape - (0.2 + 0.25) / 2 * 100) < 1e-9
    assert abs(m.mae - (1 + 2 + 5) / 3) < 1e-9


def test_e9_all_zero_metrics(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)] * 5, "k int, revenue double, prediction double")
    m = with_confidence(evaluate(df, ["k"])).first()
    assert m.mape is None and m.r2 is None and m.confidence_score == 0.5 and m.mae == 0.0
