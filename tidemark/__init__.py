"""tidemark — a Spark-native sales analytics and forecasting engine.

Every operator takes and returns DataFrames and is keyed by ``keys``
(default ``["dataset_id"]``) so one job serves any number of datasets or
series at once.  Nothing data-sized is collected to the driver.
"""

from tidemark.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
