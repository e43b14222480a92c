"""Running counters and histograms, and interval samples with a watermark.

Counters grow for the life of the stream, as their batch forms do over a whole log.
Each batch writes only the label sets it changed into a compacted log of changes
(``streaming.change_log``), whose newest row per label set is the current value; a batch
that is run again is written once.  The running aggregates themselves are held in RocksDB on the
executors' disks (``ON_DISK``), not in their heaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.operators import counters
from edgetide.operators.ordered import join_same
from edgetide.staging import scope, stage
from edgetide.streaming.change_log import ChangeLog

ON_DISK = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


MARK_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def on_disk(spark: SparkSession) -> None:
    """State of streams that are started from now on in RocksDB; a checkpoint keeps what it began with."""
    for key, value in ON_DISK.items():
        spark.conf.set(key, value)


def running_aggregate(records: DataFrame, labels: Sequence[str], aggregates: Sequence[Column]
                      ) -> DataFrame:
    return records.groupBy(*labels).agg(*aggregates)


def running_counter(records: DataFrame, labels: Sequence[str]) -> DataFrame:
    return running_aggregate(records, labels, [F.count("*").alias("requests")])


def running_bytes(records: DataFrame) -> DataFrame:
    return running_aggregate(records, counters.BYTES_LABELS,
                             [F.sum("body_bytes_sent").alias("bytes_sent")])


def running_histogram(records: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    """One wide row per label set; ``counters.histogram_rows`` makes the bucket rows."""
    return running_aggregate(records, labels, counters.histogram_aggregates(F.col(value)))


def write_changes(aggregate: DataFrame, labels: Sequence[str], path: str, checkpoint: str,
                  trigger: dict | None = None):
    """Start the stream of changed label sets into ``path``; stops when input is used up."""
    def save(batch: DataFrame, number: int) -> None:
        ChangeLog(batch.sparkSession, path, labels, checkpoint).append(number, batch)

    on_disk(aggregate.sparkSession)
    return (aggregate.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def current_values(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame | None:
    """The newest row per label set; None before the first batch."""
    return ChangeLog(spark, path, labels).current()


def interval_counts(records: DataFrame, labels: Sequence[str], every: str = "10 seconds",
                    late: str = "1 minute") -> DataFrame:
    """Requests per interval; a row later than the watermark is dropped (``count_intervals`` keeps it)."""
    return (records.withWatermark("ts", late)
            .groupBy(F.window("ts", every), *labels).agg(F.count("*").alias("requests"))
            .select(F.col("window.start").alias("window_start"), *labels, "requests"))


def sliding_rates(records: DataFrame, labels: Sequence[str], width_s: int = 300,
                  slide_s: int = 60, late: str = "1 minute") -> DataFrame:
    """Requests per second over a sliding window."""
    return (records.withWatermark("ts", late)
            .groupBy(F.window("ts", f"{width_s} seconds", f"{slide_s} seconds"), *labels)
            .agg(F.count("*").alias("requests"))
            .select(F.col("window.start").alias("window_start"), *labels, "requests",
                    (F.col("requests") / F.lit(float(width_s))).alias("per_second")))


def residency_sessions(records: DataFrame, inactive: str, by=("cdn_region", "path"),
                       late: str = "1 minute") -> DataFrame:
    """Stays of objects in a cache that drops them after ``inactive`` without access."""
    return (records.withWatermark("ts", late)
            .groupBy(*by, F.session_window("ts", inactive)).agg(
                F.min("ts").alias("session_start"), F.max("ts").alias("last_access"),
                F.count("*").alias("accesses"))
            .drop("session_window"))


def append_closed(frame: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write windows once the watermark has passed them."""
    return (frame.writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def count_intervals(records: DataFrame, labels: Sequence[str], out: str, late_out: str, checkpoint: str,
                    every: str = "10 seconds", late: str = "1 minute", trigger: dict | None = None):
    """``interval_counts`` that keeps what comes too late.

    A batch's watermark is the newest time of the batches before it, less ``late``.  Rows whose interval
    ended by then are written to ``late_out`` as they are, under the batch's number; all others are
    counted into a log of changes at ``out`` (``interval_values``).  Each row is in one of the
    two, once, also when a batch is run again.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = ChangeLog(spark, out, ["window_start", *labels], checkpoint)
        if log.has(number):
            return
        mark = log.facts.get("mark")
        with scope(spark):
            rows = stage(batch.withColumn("_window", F.window("ts", every)), "batch")
            passed = F.lit(False) if mark is None else F.col("_window.end") <= F.lit(mark).cast("timestamp")
            rows.filter(passed).drop("_window").write.mode("overwrite").parquet(f"{late_out}/batch={number}")
            counts = rows.filter(~passed).groupBy(F.col("_window.start").alias("window_start"), *labels).agg(
                F.count("*").alias("requests"))
            old = log.current()
            if old is not None:
                open_ = old.filter(F.col("window_start") + F.expr(f"INTERVAL {every}") > F.lit(mark).cast("timestamp")) \
                    if mark else old
                counts = join_same(counts, open_.withColumnRenamed("requests", "_before"), log.keys, "left").select(
                    *log.keys, (F.col("requests") + F.coalesce("_before", F.lit(0))).alias("requests"))
            after = rows.agg(F.date_format(F.max("ts") - F.expr(f"INTERVAL {late}"), MARK_FORMAT)).first()[0]
            log.append(number, counts, {"mark": max(filter(None, (mark, after)), default=None)})

    return (records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def interval_values(spark: SparkSession, out: str, labels: Sequence[str], every: str = "10 seconds",
                    closed: bool = True) -> DataFrame | None:
    """Counts per interval; with ``closed`` only of those the watermark has passed, which can't change."""
    log = ChangeLog(spark, out, ["window_start", *labels])
    rows = log.current()
    if rows is None or not closed:
        return rows
    mark = F.lit(log.facts.get("mark")).cast("timestamp")
    return rows.filter(F.col("window_start") + F.expr(f"INTERVAL {every}") <= mark)


def late_rows(spark: SparkSession, late_out: str) -> DataFrame:
    """The rows that came too late, with the ``batch`` they came in."""
    return spark.read.parquet(late_out)
