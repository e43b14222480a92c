"""Label-keyed counters and histograms over typed log records, batch or stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed

REQUEST_LABELS = ["method", "status", "cache_status", "cdn_region"]
BYTES_LABELS = ["method", "status", "cache_status"]
DURATION_LABELS = ["method", "status", "cache_status"]
LATENCY_LABELS = ["method", "status", "cdn_region"]
STATUS_LABELS = ["method", "status", "path"]
CACHE_LABELS = ["method", "status", "cache_status", "cdn_region"]
RATIO_LABELS = ["cache_status", "cdn_region", "method"]


def count_by(records: DataFrame, labels: Sequence, name: str = "requests") -> DataFrame:
    return records.groupBy(*labels).agg(F.count("*").alias(name))


def requests_total(records: DataFrame) -> DataFrame:
    return count_by(records, REQUEST_LABELS)


def bytes_total(records: DataFrame) -> DataFrame:
    return records.groupBy(*BYTES_LABELS).agg(F.sum("body_bytes_sent").alias("bytes_sent"))


def status_total(records: DataFrame) -> DataFrame:
    return count_by(records, STATUS_LABELS)


def cache_status_total(records: DataFrame) -> DataFrame:
    return count_by(records, CACHE_LABELS)


def cache_requests(records: DataFrame) -> DataFrame:
    return count_by(records, RATIO_LABELS)


def hit_ratio(records: DataFrame) -> DataFrame:
    return records.groupBy("cdn_region", "method").agg(
        F.count_if(F.col("cache_status") == "HIT").alias("hits"),
        F.count("*").alias("requests"),
    ).withColumn("hit_ratio", F.col("hits") / F.col("requests"))


def histogram_aggregates(value: Column, bounds: Sequence[float] = tuple(fixed.HISTOGRAM_BOUNDS)
                         ) -> list[Column]:
    """One count per cumulative bucket, then sum and count; NULL values do not count."""
    buckets = [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return [*buckets, F.count(value).alias("le_inf"), F.sum(value).alias("value_sum"),
            F.count(value).alias("value_count")]


def histogram_rows(wide: DataFrame, labels: Sequence,
                   bounds: Sequence[float] = tuple(fixed.HISTOGRAM_BOUNDS)) -> DataFrame:
    """The aggregated row as one row per bucket bound (``le`` as text, last ``+Inf``)."""
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("bucket"))
             for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("bucket")))
    return (wide.withColumn("_b", F.explode(F.array(*pairs)))
            .select(*labels, "_b.le", "_b.bucket", "value_sum", "value_count"))


def histogram(records: DataFrame, labels: Sequence, value: str) -> DataFrame:
    wide = records.groupBy(*labels).agg(*histogram_aggregates(F.col(value)))
    return histogram_rows(wide, labels)


def duration_histogram(records: DataFrame) -> DataFrame:
    return histogram(records, DURATION_LABELS, "request_time")


def latency_histogram(records: DataFrame) -> DataFrame:
    return histogram(records, LATENCY_LABELS, "lat")


def sampled(records: DataFrame, labels: Sequence, every: str = "10 seconds",
            ts: str = "ts") -> DataFrame:
    """Requests per fixed interval and label set."""
    return (records.groupBy(F.window(ts, every), *labels).agg(F.count("*").alias("requests"))
            .select(F.col("window.start").alias("window_start"), *labels, "requests"))


def sliding_rate(records: DataFrame, labels: Sequence, width_s: int = 300, slide_s: int = 60,
                 ts: str = "ts") -> DataFrame:
    """Requests per second over a sliding window.

    Rows are counted per slide step first, so each row is not multiplied by the number
    of windows that hold it before the shuffle.
    """
    steps = sampled(records, labels, f"{slide_s} seconds", ts)
    return (steps.groupBy(F.window("window_start", f"{width_s} seconds", f"{slide_s} seconds"),
                          *labels)
            .agg(F.sum("requests").alias("requests"))
            .select(F.col("window.start").alias("window_start"), *labels, "requests",
                    (F.col("requests") / F.lit(float(width_s))).alias("per_second")))
