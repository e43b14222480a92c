"""Audits of edge behaviour: residency, freshness and request rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths
from edgetide.operators.trace import history, positioned


def residency(accesses: DataFrame, inactive_s: int, by=("cdn_region", "file_id"),
              ts: str = "ts") -> DataFrame:
    """Stays of objects in a cache that drops them after ``inactive_s`` without access.

    Two accesses in one slot of that width are always in one stay, so accesses are
    first counted per slot (combined before the shuffle); an object then has one row
    per slot, however often it is asked for.
    """
    slot = F.floor(paths.epoch_seconds(F.col(ts)) / F.lit(inactive_s)).alias("_slot")
    slots = accesses.groupBy(*by, slot).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_slot")
    gap = paths.seconds_between(F.lag("_last").over(order), F.col("_first"))
    starts = F.coalesce((gap >= inactive_s).cast("int"), F.lit(0))
    return (slots.withColumn("_starts", starts)
            .withColumn("stay", F.sum("_starts").over(order))
            .groupBy(*by, "stay")
            .agg(F.min("_first").alias("session_start"), F.max("_last").alias("last_access"),
                 F.sum("_n").alias("accesses"))
            .withColumn("leaves_at", F.timestamp_add("SECOND", F.lit(inactive_s), "last_access")))


def freshness(accesses: DataFrame, key: str, kind: str = "media", by=("cdn_region", "file_id"),
              ts: str = "ts") -> DataFrame:
    """Repeat accesses with the age of the entry and whether it had gone stale.

    How long an entry stays fresh depends on the status it was stored with; NULL where
    that status is not cached.
    """
    return stale_flags(history(positioned(accesses, key, ts), by, ts, carry=("status",)), kind)


def stale_flags(trace: DataFrame, kind: str = "media") -> DataFrame:
    """Freshness of rows that carry prev_status and their age, from a log or a stream."""
    valid = paths.one_of(F.col("prev_status"),
                         {s: n for (k, s), n in fixed.FRESH_SECONDS.items() if k == kind})
    return (trace.filter(F.col("prev_status").isNotNull())
            .withColumn("stale", F.col("age_since_last_access") > valid))


def over_rate(accesses: DataFrame, rate: int, burst: int = 0, client: str = "ip",
              ts: str = "ts", slot: str = "1 second") -> DataFrame:
    """Clients with more than rate + burst requests in one slot.

    A count per slot; `rate_limits.leaky_bucket` replays the edge's own bucket.
    """
    return (accesses.groupBy(client, F.window(ts, slot)).agg(F.count("*").alias("requests"))
            .filter(F.col("requests") > rate + burst)
            .select(client, F.col("window.start").alias("slot"), "requests"))
