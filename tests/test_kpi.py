import datetime as dt

from conftest import F1_HEADER, F1_ROWS, upload
from tidemark.operators import aggregates as agg
from tidemark.operators import kpi
from tidemark.operators.ingest import validate_and_clean


def _sales(spark, tmp_path, header, rows, name="s.csv"):
    clean, _ = validate_and_clean(upload(spark, tmp_path, name, header, rows))
    return clean


def test_f1_kpis(spark, tmp_path):
    k = kpi.compute_kpis(_sales(spark, tmp_path, F1_HEADER, F1_ROWS)).first()
    assert k.total_revenue == 120.0 and k.total_units_sold == 10.0
    assert k.total_orders == 3 and k.average_order_value == 40.0
    assert k.average_daily_revenue == 40.0
    assert k.top_product == "Widget" and k.top_region == "North" and k.top_category == "Gadgets"
    assert k.revenue_growth_mom_pct is None and k.revenue_growth_yoy_pct is None
    assert k.forecast_accuracy_pct is None


def test_f1_breakdown_shares(spark, tmp_path):
    b = agg.breakdown(_sales(spark, tmp_path, F1_HEADER, F1_ROWS), "product").collect()
    shares = {r.label: r.share_pct for r in b}
    assert shares == {"Widget": 66.67, "Gizmo": 33.33}


def test_e7_gap_month(spark, tmp_path):
    s = _sales(spark, tmp_path, "Date,Revenue", ["2024-01-10,10", "2024-03-05,30"])
    k = kpi.compute_kpis(s).first()
    assert k.revenue_growth_mom_pct is None          # February is an empty month
    trend = agg.revenue_trend(s, "ME").orderBy("period").collect()
    assert [(r.period, r.revenue) for r in trend] == [
        ("2024-01-31", 10.0), ("2024-02-29", 0.0), ("2024-03-31", 30.0)]


def test_mom_and_target(spark, tmp_path):
    s = _sales(spark, tmp_path, "Date,Revenue", ["2024-01-10,10", "2024-02-05,30"])
    k = kpi.compute_kpis(s, sales_target=80.0).first()
    assert k.revenue_growth_mom_pct == 200.0
    assert k.sales_target_achievement_pct == 50.0


def test_e8_tie_goes_to_smaller_name(spark, tmp_path):
    s = _sales(spark, tmp_path, "Date,Product,Revenue", ["2024-01-01,Zed,10", "2024-01-01,Abe,10"])
    assert kpi.compute_kpis(s).first().top_product == "Abe"


def test_weekly_labels_end_on_sunday(spark, tmp_path):
    s = _sales(spark, tmp_path, "Date,Revenue", ["2024-12-30,1", "2025-01-06,2"])
    t = agg.revenue_trend(s, "W").orderBy("period").collect()
    assert [(r.period, r.revenue) for r in t] == [("2025-01-05", 1.0), ("2025-01-12", 2.0)]
    for r in t:
        assert dt.date.fromisoformat(r.period).weekday() == 6
