"""Streaming scan of access-log files; the checkpoint remembers what was read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.sources import access_logs
from edgetide.streaming.byte_tail import ByteTail


def tail_lines(spark: SparkSession, path: str, files_per_batch: int | None = None, **options) -> DataFrame:
    """Lines of the files that match ``path``, as they are written.

    Files on a mount are followed byte by byte (``streaming.byte_tail``): appended lines arrive, and a
    file is followed through rotation and truncation.  Object stores hold files that
    never change; there, and with ``files_per_batch``, each file is read once, when it appears.
    """
    if files_per_batch or not re.match(r"/|file:|[^:/]+/|[^:/]+$", path):
        reader = spark.readStream.option("latestFirst", "false")
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.text(path)
    spark.dataSource.register(ByteTail)
    # without it Spark runs this source once and never the last batch, which moves the watermark
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
    return spark.readStream.format("byte_tail").options(**options).load(path).select("value")


def tail_records(spark: SparkSession, path: str, files_per_batch: int | None = None, **options) -> DataFrame:
    """Typed records with method and path; ``ts`` is an instant, as watermarks need."""
    lines = tail_lines(spark, path, files_per_batch, **options)
    return access_logs.split_request(access_logs.parse_extended(lines, keep_instant=True))


def json_debug(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Every record as one JSON line; returns the started query."""
    return (records.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("text")
            .option("checkpointLocation", checkpoint).option("path", path)
            .trigger(**(trigger or {"availableNow": True})).start())
