"""Session construction and shared-folder helpers.

On a cluster the session is created by the platform; ``build_session`` is
for local runs and tests.  ``ensure_checkpoint_dir`` never overrides a
``spark.checkpoint.dir`` the cluster already names.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every tidemark job relies on.  AQE re-plans joins from runtime
# sizes (a checked broadcast with sort-merge beyond it) and splits skewed
# shuffle partitions; the session zone is pinned so dates never shift.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of materialised panels are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "tidemark",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf.setdefault("spark.driver.memory", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  Where the session names none, a
    temporary one is made for a local master only: on a cluster each machine
    would write to its own disk, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("no shared folder: set spark.checkpoint.dir to one that all executors see")
        named = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through Hadoop's FileSystem: local, HDFS or object store."""
    fs, hpath = _fs_and_path(spark, path)
    return bool(fs.exists(hpath))


def file_signature(spark: SparkSession, path: str) -> tuple:
    """Identity of a file, or of every file below a folder (a table folder's
    own status need not change with its contents), any scheme."""
    fs, hpath = _fs_and_path(spark, path)
    if not fs.exists(hpath):
        return (path, None)
    found, it = [], fs.listFiles(hpath, True)
    while it.hasNext():
        st = it.next()
        found.append((st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())))
    return (path, tuple(sorted(found)))


SCAN_BYTES = 16 << 20        # of a file, read by one task of a build
TASK_BYTES = 8 << 20         # of a shuffle, read by one task of a build


def _bytes_conf(spark: SparkSession, key: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))


@contextmanager
def bounded_tasks(spark: SparkSession, source_bytes: int):
    """Jobs run in the block deal their rows to more tasks as the sources
    grow, instead of more rows to a task: what a task sorts (for a merge join,
    for a partitioned write) then stays the same at every scale.  Settings
    that are finer already are kept, all are put back after the block."""
    wanted = {
        "spark.sql.shuffle.partitions": max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * source_bytes // TASK_BYTES)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": min(_bytes_conf(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes"), TASK_BYTES),
        "spark.sql.files.maxPartitionBytes": min(_bytes_conf(spark, "spark.sql.files.maxPartitionBytes"), SCAN_BYTES),
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def has_data_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> bool:
    """True when a table folder holds at least one data file (any depth)."""
    fs, hpath = _fs_and_path(spark, path)
    if not fs.exists(hpath):
        return False
    it = fs.listFiles(hpath, True)
    while it.hasNext():
        if it.next().getPath().getName().endswith(suffix):
            return True
    return False


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables that
    cut lineage or hold models); survives executor loss."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, *parts)


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and cut its lineage
    (reliable ``checkpoint``, never a local one).  Used for small derived
    panels — daily series, feature matrices — that several branches of a
    plan read, so the fact scan below them runs once; a lost executor then
    re-reads the checkpoint instead of recomputing the scan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str, root: str | None = None):
    """``df`` as Parquet in a new folder of ``root``, or of the shared one:
    (path, the rows read back with their own schema)."""
    spark = df.sparkSession
    folder = (name, uuid.uuid4().hex)
    path = os.path.join(root, *folder) if root else shared_path(spark, *folder)
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def write_once(df, name: str):
    """``df`` as Parquet in the shared folder, read back with its own schema:
    for rows that several passes of a job need parsed, columns pruned."""
    return written(df, name)[1]
