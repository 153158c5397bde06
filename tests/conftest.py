import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session
    s = build_session("local[4]", app_name="tidemark-tests", shuffle_partitions=4,
                      extra_conf={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tm-ckpt-"),
                                  "spark.driver.memory": "4g"})
    yield s
    s.stop()


def upload(spark, tmp_path, name, header, rows, dataset_id=1):
    """Write a CSV upload and read it back as the raw all-string frame."""
    from tidemark.sources.uploads import read_upload_csv
    p = tmp_path / name
    p.write_text("\n".join([header] + rows) + "\n")
    return read_upload_csv(spark, str(p), dataset_id)


F1_HEADER = "Order Date,Product,Category,Region,Quantity,Unit Price,Revenue"
F1_ROWS = ["2024-01-01,Widget,Gadgets,North,5,10,50",
           "2024-01-02,Widget,Gadgets,North,3,10,30",
           "2024-01-03,Gizmo,Gadgets,South,2,20,40"]


def f2_rows():
    import datetime as dt
    out = []
    for i in range(60):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        rev = 100 + (i % 7) * 10
        out.append(f"{d.isoformat()},Widget,Gadgets,North,5,{rev / 5},{rev}")
    return out
