"""Registered queries against their DuckDB texts on the smallest tables."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.sources.warehouse import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["breakdown_category", "top_products", "trend_weekly", "trend_monthly", "kpi_summary",
        "daily_series", "feature_matrix", "pick_best", "forecast_band", "ingest_clean",
        "ingest_report", "recent_activity_all", "cascade_delete"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = round(v, 6)
            elif hasattr(v, "isoformat"):
                v = v.isoformat()
            vals.append(v)
        out.append(repr(tuple(vals)))
    return sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), ocols)


def test_entry_smoke(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_ingest_stores_what_batch_validation_reports(spark):
    q = entry.queries()
    streamed = {r.segment: r for r in q["stream_ingest"](spark, SF).collect()}
    report = {r.dataset_id.lower(): r for r in q["ingest_report"](spark, SF).collect()}
    assert set(streamed) == set(report)
    for seg, r in streamed.items():
        assert r.status == "processed"
        assert r.row_count == r.stored_rows == report[seg].valid_rows
