"""Session settings and the shared folder for written intermediate tables."""

import re
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_registered: set[str] = set()
_work = threading.local()  # a stream's batches run in threads of their own


def build_session(app_name: str = "reldrift", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC and the state store that streams need; all else is left to the cluster.

    A byte of text is much work here, so small partitions are not merged below 64 KiB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, which every executor can reach.

    Inside :func:`work_folder` it is that folder.  Else it is a folder of this application
    below ``spark.checkpoint.dir``, which a cluster must name; a local session may leave it
    unset and has it below the warehouse.  It is removed when the application's JVM ends.
    """
    if getattr(_work, "folder", None):
        return _work.folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.rstrip('/')}/work-{spark.sparkContext.applicationId}"
    if folder not in _registered:
        path, files = hadoop_path(spark, folder)
        files.deleteOnExit(path)
        _registered.add(folder)
    return folder


@contextmanager
def work_folder(spark: SparkSession, folder: str):
    """Let :func:`materialize` write below ``folder``, emptied before and removed afterwards."""
    path, files = hadoop_path(spark, folder)
    files.delete(path, True)
    before, _work.folder = getattr(_work, "folder", None), folder.rstrip("/")
    try:
        yield
    finally:
        _work.folder = before
        files.delete(path, True)


def hadoop_path(spark: SparkSession, folder: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several branches of a plan read, and return the written one.

    The table is computed once, its columns are pruned per branch, and a lost
    executor costs a re-read instead of a recomputation.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
