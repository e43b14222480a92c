"""Probe logs: what a prober saw for each request it sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_COLUMNS = ["timestamp", "status_code", "response_time", "size_bytes", "url"]


def read_probe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows that start with a digit; the header and ``Day n`` lines are skipped.

    ``status_code`` stays text because it also holds FAILED and RETRY_n.
    """
    lines = spark.read.text(path).filter(F.col("value").rlike("^[0-9]"))
    f = F.split("value", ",", 5)
    return lines.select(
        f[0].try_cast("timestamp_ntz").alias("ts"), F.get(f, F.lit(1)).alias("status_code"),
        F.get(f, F.lit(2)).try_cast("double").alias("response_time"),
        F.get(f, F.lit(3)).try_cast("bigint").alias("size_bytes"),
        F.get(f, F.lit(4)).alias("url"))


def read_probe_text(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated rows: status, total time, URL."""
    f = F.split("value", " ", 3)
    return spark.read.text(path).select(
        f[0].try_cast("int").alias("status"),
        F.get(f, F.lit(1)).try_cast("double").alias("time_total"),
        F.get(f, F.lit(2)).alias("url"))
