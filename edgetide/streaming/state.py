"""Keyed state of a stream as a compacted log of changes.

A batch joins the state before it with its own pre-aggregated rows, so a hot object is one row on
either side, and writes back the objects it touched (``streaming.change_log``): the
files do not grow with the number of batches, and a batch that is run again finds the same state or is
done.  What a batch stages is deleted at its end.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import scores
from edgetide.operators import trace
from edgetide.operators.ordered import join_same
from edgetide.sources.access_logs import utc
from edgetide.staging import scope, stage
from edgetide.streaming.change_log import ChangeLog


def stream_features(records: DataFrame, key: str, out: str, state: str, checkpoint: str,
                    by=("cdn_region", "file_id"), carry: tuple[str, ...] = (),
                    trigger: dict | None = None, forget: str | None = None):
    """Running count, age, rate and recency of each access, over all batches.

    ``key`` makes (ts, key) unique inside a batch.  Columns in ``carry`` come out as
    ``prev_<column>``; with ``status`` the rows fit ``operators.audits.stale_flags``.  ``forget`` is an
    interval such as ``30 days``: objects without an access for so long before the stream's newest one
    start anew.
    """
    by = list(by)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = ChangeLog(spark, state, by, checkpoint)
        if log.has(number):
            return
        newest = log.facts.get("newest")
        if forget and newest:
            log.keep = F.col("state_last.ts") >= F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {forget}")
        with scope(spark):
            old = log.current()
            rows = trace.positioned(batch.withColumn("ts", utc(F.col("ts"))), key)
            trace.history(rows, by, carry=carry, state=old).drop("_block").write.mode("overwrite").parquet(
                f"{out}/batch={number}")
            last = rows.agg(F.max("ts")).first()[0]
            newest = max(filter(None, (newest, last and last.isoformat())), default=None)
            log.append(number, trace.object_state(rows, by, carry=carry, state=old, changed=True), {"newest": newest})

    return (records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _decayed_to(clock: dt.datetime, frequency: str = "frequency", since: str = "decayed_at"):
    """A frequency brought to ``clock``; what is below the least one counts as gone (NULL).

    Decays multiply, so one over the sum of the hours equals one per batch.
    """
    hours = scores.age_seconds(F.col(since), clock) / 3600.0
    return F.when(hours > 0, scores.decayed(F.col(frequency), hours)).otherwise(F.col(frequency))


def stream_frequencies(records: DataFrame, state: str, checkpoint: str,
                       by=("cdn_region", "file_id"), trigger: dict | None = None):
    """Decayed access frequency per object.

    The state's clock is event time: each batch's newest access is its ``as_of``, and
    the decay covers the hours since the last decay, once there is at least one.  An object is
    decayed when it is next touched or read, so a batch writes its own objects only.
    """
    by = list(by)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = ChangeLog(spark, state, by, checkpoint)
        if log.has(number):
            return
        with scope(spark):
            current = stage(batch.withColumn("ts", utc(F.col("ts"))).groupBy(*by).agg(
                F.count("*").alias("access_count"), F.max("ts").alias("last_access")), "batch")
            as_of = current.agg(F.max("last_access")).first()[0]
            before = log.facts.get("clock") and dt.datetime.fromisoformat(log.facts["clock"])
            clock = before
            if as_of and (before is None or (as_of - before).total_seconds() >= 3600):
                clock = as_of
            moment = as_of or clock or dt.datetime(1970, 1, 1)
            age = scores.age_seconds(F.col("last_access"), moment) / 3600.0
            fresh = current.select(*by, scores.weighted_frequency(age, F.col("access_count")).alias("frequency"))
            old = log.current()
            if old is not None:
                held = old.select(*by, _decayed_to(clock or moment).alias("_old"))
                fresh = join_same(fresh, held, by, "left").select(*by, F.greatest(
                    F.coalesce("frequency", F.lit(0.0)), F.coalesce("_old", F.lit(0.0))).alias("frequency"))
            log.append(number, fresh.withColumn("decayed_at", scores.moment(clock or moment)),
                       {"clock": clock.isoformat() if clock else None})

    return (records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_frequencies(spark: SparkSession, state: str, by=("cdn_region", "file_id")) -> DataFrame | None:
    """Frequencies as of the stream's clock; None before the first batch."""
    log = ChangeLog(spark, state, by)
    rows = log.current()
    if rows is None or not log.facts.get("clock"):
        return rows
    return rows.withColumn("frequency", _decayed_to(dt.datetime.fromisoformat(log.facts["clock"]))) \
        .filter(F.col("frequency").isNotNull()).drop("decayed_at")
