"""All request metrics of a log in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.operators import counters
from edgetide.staging import stage

LABELS = ["method", "status", "cache_status", "cdn_region", "path"]


def _histogram_names(prefix: str) -> list[str]:
    return [f"{prefix}_le_{i}" for i in range(len(fixed.HISTOGRAM_BOUNDS))] + [
        f"{prefix}_le_inf", f"{prefix}_value_sum", f"{prefix}_value_count"]


def base_table(records: DataFrame) -> DataFrame:
    """Counts, bytes and histogram buckets per full label set, combined before the shuffle.

    Every metric adds up from these rows, so the log itself is parsed once.
    """
    aggregates = [F.count("*").alias("requests"), F.sum("body_bytes_sent").alias("bytes_sent")]
    for prefix, value in (("duration", "request_time"), ("latency", "lat")):
        made = counters.histogram_aggregates(F.col(value))
        aggregates += [a.alias(n) for a, n in zip(made, _histogram_names(prefix))]
    return stage(records.groupBy(*LABELS).agg(*aggregates), "metric-base")


def _sum(base: DataFrame, labels: list[str], value: str) -> DataFrame:
    return base.groupBy(*labels).agg(F.sum(value).alias(value))


def _histogram(base: DataFrame, labels: list[str], prefix: str) -> DataFrame:
    names = _histogram_names(prefix)
    wide = base.groupBy(*labels).agg(
        *[F.sum(n).alias(n[len(prefix) + 1:]) for n in names])
    return counters.histogram_rows(wide, labels)


def metric_tables(records: DataFrame) -> dict[str, DataFrame]:
    base = base_table(records)
    return {
        "requests_total": _sum(base, counters.REQUEST_LABELS, "requests"),
        "bytes_total": _sum(base, counters.BYTES_LABELS, "bytes_sent"),
        "duration": _histogram(base, counters.DURATION_LABELS, "duration"),
        "latency": _histogram(base, counters.LATENCY_LABELS, "latency"),
        "status_total": _sum(base, counters.STATUS_LABELS, "requests"),
        "cache_status_total": _sum(base, counters.CACHE_LABELS, "requests"),
        "cache_requests": _sum(base, counters.RATIO_LABELS, "requests"),
    }
