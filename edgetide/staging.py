"""Written intermediate tables.

Some steps need an intermediate result that is fixed before later steps read it
twice (range blocks), or one whose true size decides how it is joined (totals).
Both are written as parquet below the folder the cluster names in
``spark.checkpoint.dir``: executors may be lost afterwards without recomputing the
lineage, and the files give the planner exact sizes, so it broadcasts a staged
table only when it fits ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
otherwise.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_scopes = threading.local()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: for steps that run again and again."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.paths:
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
        _scopes.paths = outer


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; a private one only in local mode when none is set."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="edgetide-")
    return _local_root


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root, removed when the driver exits."""
    path = f"{scratch_root(spark)}/edgetide/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop_path)
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
