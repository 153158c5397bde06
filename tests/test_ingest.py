import pytest
from pyspark.sql import functions as F

from conftest import F1_HEADER, F1_ROWS, upload
from tidemark.operators.ingest import map_columns, validate_and_clean
from tidemark.sources.uploads import check_extension


def test_header_mapping_substring_steals():
    rename, detected, _ = map_columns(["Date", "Item", "Discount", "Total Price"])
    assert detected["order_date"] == "Date"
    assert detected["product"] == "Item"
    assert detected["quantity"] == "Discount"          # 'count' inside 'discount'
    assert detected["unit_price"] == "Total Price"     # 'price' before revenue's aliases
    assert "revenue" not in detected


def test_header_mapping_exact_mode():
    _, detected, _ = map_columns(["Date", "Discount", "Total Price"], match="exact")
    assert "quantity" not in detected
    assert detected["revenue"] == "Total Price"


def test_duplicate_name_after_rename():
    rename, detected, warnings = map_columns(["Sales", "revenue", "Date"])
    assert detected["revenue"] == "Sales"
    assert rename["revenue"] == "revenue__src"
    assert warnings


def test_f1_three_rows(spark, tmp_path):
    raw = upload(spark, tmp_path, "f1.csv", F1_HEADER, F1_ROWS)
    clean, report = validate_and_clean(raw)
    rows = clean.orderBy("order_date").collect()
    assert len(rows) == 3
    assert [r.revenue for r in rows] == [50.0, 30.0, 40.0]
    rep = report.first()
    assert rep.is_valid and rep.total_rows == 3 and rep.valid_rows == 3
    assert rep.detected_columns["order_date"] == "Order Date"


def test_f3_wrong_extension():
    with pytest.raises(ValueError):
        check_extension("data.txt")
    assert check_extension("DATA.CSV")


def test_e3_coercion_and_derived_revenue(spark, tmp_path):
    raw = upload(spark, tmp_path, "e3.csv", "Date,Qty,Price",
                 ["2024-01-01,2,5", "01/02/2024,1,1", "bad,3,3", ",4,4", "2024-01-05,1d,7"])
    clean, report = validate_and_clean(raw)
    got = {str(r.order_date): (r.quantity, r.unit_price, r.revenue) for r in clean.collect()}
    # first value fixes the format: the US-style date and 'bad' are dropped,
    # the empty date too; '1d' is not a number (quantity -> 1, revenue -> 0)
    assert got == {"2024-01-01": (2.0, 5.0, 10.0), "2024-01-05": (1.0, 7.0, 0.0)}
    rep = report.first()
    assert rep.valid_rows == 2 and rep.invalid_rows == 3
    assert any("unparseable dates" in w for w in rep.warnings)


def test_e3_lenient_mode(spark, tmp_path):
    raw = upload(spark, tmp_path, "e3l.csv", "Date,Qty,Price",
                 ["2024-01-01,2,5", "01/02/2024,1,1"])
    clean, _ = validate_and_clean(raw, date_mode="lenient")
    assert clean.count() == 2


def test_e4_fallback_column(spark, tmp_path):
    raw = upload(spark, tmp_path, "e4.csv", "Date,Zeta,Alpha",
                 ["2024-01-01,5,7", "2024-01-02,6,8"])
    clean, report = validate_and_clean(raw)
    assert sorted(r.revenue for r in clean.collect()) == [7.0, 8.0]
    assert "Revenue auto-mapped from numeric column 'Alpha'." in report.first().warnings


def test_e5_negative_and_fills(spark, tmp_path):
    raw = upload(spark, tmp_path, "e5.csv", "Date,Revenue",
                 ["2024-01-01,-1", "2024-01-02,0", "2024-01-03,", "2024-01-04,5"])
    clean, report = validate_and_clean(raw)
    rows = {str(r.order_date): r for r in clean.collect()}
    assert set(rows) == {"2024-01-02", "2024-01-03", "2024-01-04"}
    assert rows["2024-01-03"].revenue == 0.0 and rows["2024-01-03"].quantity == 1.0
    assert rows["2024-01-04"].unit_price == 5.0
    assert rows["2024-01-02"].product == "Unknown Product"
    assert rows["2024-01-02"].region == "Unknown Region"
    assert any("negative revenue" in w for w in report.first().warnings)


def test_e6_missing_date(spark, tmp_path):
    raw = upload(spark, tmp_path, "e6.csv", "A,B", ["1,2", "3,4"])
    clean, report = validate_and_clean(raw)
    rep = report.first()
    assert clean.count() == 0
    assert not rep.is_valid and rep.invalid_rows == 2 and rep.missing_columns == ["order_date"]


@pytest.mark.parametrize("values,days", [
    (["1/5/2024", "1/6/2024", "12/25/2024"], ["2024-01-05", "2024-01-06", "2024-12-25"]),
    (["13/01/2024", "2/03/2024"], ["2024-01-13", "2024-03-02"]),
    (["2024-01-01T10:00:00Z", "2024-01-02T23:59:59Z"], ["2024-01-01", "2024-01-02"]),
    (["2024-01-01 10:00:00.123", "2024-01-02 10:00:00"], ["2024-01-01", "2024-01-02"]),
    (["01-Jan-2024", "15-December-2024"], ["2024-01-01", "2024-12-15"]),
    (["Jan 5, 2024", "Feb 30, 2024"], ["2024-01-05"]),
    (["01/02/24", "12/31/99"], ["2024-01-02", "1999-12-31"]),
    (["20240105", "2024-01-06"], ["2024-01-05"]),
])
def test_dates_as_users_write_them(spark, values, days):
    raw = spark.createDataFrame([(1, i, v, "5") for i, v in enumerate(values)],
                                "dataset_id int, _row int, Date string, Revenue string")
    clean, report = validate_and_clean(raw)
    assert [str(r.order_date) for r in clean.orderBy("order_date").collect()] == sorted(days)


def test_quoted_fields_and_reserved_headers(spark, tmp_path):
    p = tmp_path / "jan sales.csv"
    p.write_text('Date,Product,Revenue,dataset_id,_row\n2024-01-01,"Pro ""X"", big",10,7,a\n'
                 '2024-01-02,"two\nlines",20,7,b\n')
    from tidemark.sources.uploads import read_upload_csv
    clean, report = validate_and_clean(read_upload_csv(spark, str(p), 3))
    rows = {r["product"]: (r.dataset_id, r.revenue) for r in clean.collect()}
    assert rows == {'Pro "X", big': (3, 10.0), "two\nlines": (3, 20.0)}


def test_no_shared_folder_is_an_error_on_a_cluster():
    from tidemark.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_folder_identity_follows_files_below(spark, tmp_path):
    from tidemark.session import file_signature
    folder = tmp_path / "t" / "a=1"
    folder.mkdir(parents=True)
    (folder / "x.parquet").write_text("1")
    before = file_signature(spark, str(tmp_path / "t"))
    (folder / "x.parquet").write_text("22")
    assert file_signature(spark, str(tmp_path / "t")) != before
