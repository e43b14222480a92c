"""Checks of the streams: each run ends when its input files are used up.

Log files are written in two parts from the given events (days 1-15, then the rest);
the stream runs after each part and goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.metrics import histogram_sql
from edgetide.checks.views import extended_lines
from edgetide.functions import paths
from edgetide.operators import audits, counters
from edgetide.sources.access_logs import utc
from edgetide.staging import new_path
from edgetide.streaming import running, state, tail

c = F.col


def _in_two_parts(spark, d, start):
    """Write a part, run the stream that ``start(path)`` starts, twice; the last query."""
    path = new_path(spark, "stream-log")
    lines = extended_lines(spark, d)
    started = None
    for part, rows in enumerate((lines.filter(F.dayofmonth("ts") <= 15),
                                 lines.filter(F.dayofmonth("ts") > 15))):
        rows.select("value").write.text(f"{path}/part={part}")
        started = start(f"{path}/*")
        started.awaitTermination()
        if started.exception() is not None:
            raise started.exception()
    return started


def _running(spark, d, make, labels):
    out, checkpoint = new_path(spark, "running"), new_path(spark, "checkpoint")
    _in_two_parts(spark, d, lambda p: running.write_changes(
        make(tail.tail_records(spark, p)), labels, out, checkpoint))
    return running.current_values(spark, out, labels)


@query("running_requests_x1_s16", """SELECT method, status, cache_status, cdn_region,
    count(*) AS requests FROM accesses GROUP BY ALL""")
def running_requests(spark, d):
    return _running(spark, d, lambda r: running.running_counter(r, counters.REQUEST_LABELS),
                    counters.REQUEST_LABELS)


@query("running_bytes_x1", """SELECT method, status, cache_status, CAST(sum(size) AS BIGINT)
    AS bytes_sent FROM accesses GROUP BY ALL""")
def running_bytes(spark, d):
    return _running(spark, d, running.running_bytes, counters.BYTES_LABELS)


@query("running_status_by_path_x1", """SELECT method, status, path, count(*) AS requests
    FROM accesses GROUP BY ALL""")
def running_status_by_path(spark, d):
    return _running(spark, d, lambda r: running.running_counter(r, counters.STATUS_LABELS),
                    counters.STATUS_LABELS)


@query("running_cache_requests_x1", """SELECT cache_status, cdn_region, method, count(*) AS requests
    FROM accesses GROUP BY ALL""")
def running_cache_requests(spark, d):
    return _running(spark, d, lambda r: running.running_counter(r, counters.RATIO_LABELS),
                    counters.RATIO_LABELS)


@query("running_durations_x2", histogram_sql("method, status, cache_status", "request_time"))
def running_durations(spark, d):
    wide = _running(spark, d, lambda r: running.running_histogram(
        r, counters.DURATION_LABELS, "request_time"), counters.DURATION_LABELS)
    return counters.histogram_rows(wide, counters.DURATION_LABELS).withColumn(
        "value_sum", F.round("value_sum", 6))


@query("running_latencies_x2_a13", histogram_sql("method, status, cdn_region", "lat").replace(
    "list(lat)", "list(lat) FILTER (lat IS NOT NULL)").replace("len(list_filter(v", "len(list_filter(coalesce(v, [])"))
def running_latencies(spark, d):
    wide = _running(spark, d, lambda r: running.running_histogram(
        r, counters.LATENCY_LABELS, "lat"), counters.LATENCY_LABELS)
    return counters.histogram_rows(wide, counters.LATENCY_LABELS).withColumn(
        "value_sum", F.round("value_sum", 6))


@query("running_cache_status_x1_a15", """SELECT method, status, cache_status, cdn_region, count(*) AS requests
    FROM accesses GROUP BY ALL""")
def running_cache_status(spark, d):
    return _running(spark, d, lambda r: running.running_counter(r, counters.CACHE_LABELS), counters.CACHE_LABELS)


_MARK = """WITH a AS (SELECT *, date_trunc('second', ts) AS s FROM accesses),
    mark AS (SELECT max(s) - INTERVAL '1 minute' AS mark FROM a)"""


@query("streamed_intervals_x3", _MARK + """
    SELECT time_bucket(INTERVAL '10 seconds', s) AS window_start, cdn_region, count(*) AS requests
    FROM a, mark WHERE time_bucket(INTERVAL '10 seconds', s) + INTERVAL '10 seconds' <= mark GROUP BY ALL""")
def streamed_intervals(spark, d):
    """Closed 10-second windows; the newest ones stay open behind the watermark."""
    out, checkpoint = new_path(spark, "intervals"), new_path(spark, "checkpoint")
    _in_two_parts(spark, d, lambda p: running.append_closed(
        running.interval_counts(tail.tail_records(spark, p), ["cdn_region"]), out, checkpoint))
    return spark.read.parquet(out).withColumn("window_start", utc(c("window_start")))


@query("streamed_rates_x4", _MARK + """,
    w AS (SELECT time_bucket(INTERVAL '1 minute', s) - to_minutes(CAST(m AS INTEGER)) AS window_start, cdn_region
      FROM a, (SELECT unnest(range(5)) AS m))
    SELECT window_start, cdn_region, count(*) AS requests, round(count(*) / 300.0, 6) AS per_second
    FROM w, mark WHERE window_start + INTERVAL '5 minutes' <= mark GROUP BY ALL""")
def streamed_rates(spark, d):
    out, checkpoint = new_path(spark, "rates"), new_path(spark, "checkpoint")
    _in_two_parts(spark, d, lambda p: running.append_closed(
        running.sliding_rates(tail.tail_records(spark, p), ["cdn_region"]), out, checkpoint))
    return spark.read.parquet(out).select(
        utc(c("window_start")).alias("window_start"), "cdn_region", "requests",
        F.round("per_second", 6).alias("per_second"))


@query("streamed_sessions_x5", _MARK + """,
    g AS (SELECT *, s >= lag(s) OVER w + INTERVAL '1 hour' AS fresh FROM a
      WINDOW w AS (PARTITION BY cdn_region, path ORDER BY s, event_id)),
    n AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY cdn_region, path
      ORDER BY s, event_id) AS nr FROM g),
    stays AS (SELECT cdn_region, path, min(s) AS session_start, max(s) AS last_access, count(*) AS accesses
      FROM n GROUP BY cdn_region, path, nr)
    SELECT stays.* FROM stays, mark WHERE last_access + INTERVAL '1 hour' <= mark""")
def streamed_sessions(spark, d):
    out, checkpoint = new_path(spark, "sessions"), new_path(spark, "checkpoint")
    _in_two_parts(spark, d, lambda p: running.append_closed(
        running.residency_sessions(tail.tail_records(spark, p), "1 hour"), out, checkpoint))
    return spark.read.parquet(out).select(
        "cdn_region", "path", utc(c("session_start")).alias("session_start"),
        utc(c("last_access")).alias("last_access"), "accesses")


@query("streamed_features_x9", """
    WITH h AS (SELECT event_id, cdn_region, file_id, row_number() OVER w AS access_count,
      coalesce((epoch_us(date_trunc('second', ts)) - epoch_us(lag(date_trunc('second', ts)) OVER w)) / 1e6, 0)
        AS age FROM accesses WINDOW w AS (PARTITION BY cdn_region, file_id ORDER BY date_trunc('second', ts), event_id))
    SELECT cdn_region, file_id, access_count, round(age, 6) AS age_since_last_access,
      round(1 / (1 + age / 3600), 6) AS recency_score FROM h""")
def streamed_features(spark, d):
    out, st, checkpoint = (new_path(spark, n) for n in ("features", "state", "checkpoint"))

    def start(path):
        records = tail.tail_records(spark, path)
        keyed = records.select("ts", "cdn_region", paths.object_id(c("path")).alias("file_id"),
                               F.xxhash64("remote_addr", "request", "body_bytes_sent",
                                          "http_user_agent", "status").alias("row_key"))
        return state.stream_features(keyed, "row_key", out, st, checkpoint)

    _in_two_parts(spark, d, start)
    return spark.read.parquet(out).select(
        "cdn_region", "file_id", "access_count",
        F.round("age_since_last_access", 6).alias("age_since_last_access"),
        F.round("recency_score", 6).alias("recency_score"))


@query("streamed_freshness_x6", """
    WITH prev AS (SELECT cdn_region, file_id, lag(status) OVER w AS prev_status,
      (epoch_us(date_trunc('second', ts)) - epoch_us(lag(date_trunc('second', ts)) OVER w)) / 1e6 AS age
      FROM accesses WINDOW w AS (PARTITION BY cdn_region, file_id ORDER BY date_trunc('second', ts), event_id))
    SELECT cdn_region, file_id, prev_status, age AS age_seconds, age > CASE prev_status WHEN 200 THEN 2592000
      WHEN 304 THEN 2592000 WHEN 404 THEN 60 END AS stale FROM prev WHERE prev_status IS NOT NULL""")
def streamed_freshness(spark, d):
    out, st, checkpoint = (new_path(spark, n) for n in ("freshness", "state", "checkpoint"))

    def start(path):
        records = tail.tail_records(spark, path)
        keyed = records.select("ts", "cdn_region", paths.object_id(c("path")).alias("file_id"),
                               "status", F.xxhash64("remote_addr", "request", "body_bytes_sent",
                                                    "http_user_agent", "status").alias("row_key"))
        return state.stream_features(keyed, "row_key", out, st, checkpoint, carry=("status",))

    _in_two_parts(spark, d, start)
    return audits.stale_flags(spark.read.parquet(out)).select(
        "cdn_region", "file_id", "prev_status", c("age_since_last_access").alias("age_seconds"), "stale")


@query("streamed_frequencies_x8", """
    WITH a AS (SELECT *, dayofmonth(ts) <= 15 AS early, date_trunc('second', ts) AS s FROM accesses),
    clock AS (SELECT max(s) FILTER (early) AS t1, max(s) AS t2 FROM a),
    part AS (SELECT early, cdn_region, file_id, count(*) AS n, max(s) AS last FROM a GROUP BY ALL),
    f AS (SELECT early, cdn_region, file_id, n * greatest(0.1::DOUBLE, 1 - (epoch_us(CASE WHEN early THEN t1 ELSE t2 END)
      - epoch_us(last)) / 1e6 / 3600 / 24) AS f FROM part, clock),
    old AS (SELECT cdn_region, file_id, f * pow(0.99, (epoch_us(t2) - epoch_us(t1)) / 1e6 / 3600) AS f
      FROM f, clock WHERE early)
    SELECT cdn_region, file_id, round(greatest(coalesce(o.f, 0), coalesce(n.f, 0)), 6) AS frequency
    FROM (SELECT * FROM old WHERE f >= 0.1) o FULL JOIN (SELECT * FROM f WHERE NOT early) n
      USING (cdn_region, file_id)""")
def streamed_frequencies(spark, d):
    st, checkpoint = new_path(spark, "frequency"), new_path(spark, "checkpoint")

    def start(path):
        records = tail.tail_records(spark, path).select(
            "ts", "cdn_region", paths.object_id(c("path")).alias("file_id"))
        return state.stream_frequencies(records, st, checkpoint)

    _in_two_parts(spark, d, start)
    return state.current_frequencies(spark, st).select(
        "cdn_region", "file_id", F.round("frequency", 6).alias("frequency"))


@query("late_rows_x10", _MARK + """,
    early AS (SELECT *, time_bucket(INTERVAL '1 hour', s) AS w, dayofmonth(s) > 15 OR
        time_bucket(INTERVAL '1 hour', s) + INTERVAL '1 hour' > mark AS on_time FROM a, mark),
    whole AS (SELECT w AS window_start, cdn_region, count(*) AS requests, 'closed' AS kind FROM early
      WHERE on_time AND w + INTERVAL '1 hour' <= mark GROUP BY ALL)
    SELECT * FROM whole UNION ALL SELECT w, cdn_region, count(*), 'late' FROM early WHERE NOT on_time GROUP BY ALL""")
def late_rows(spark, d):
    """Newest part first, so that the older part arrives behind the watermark."""
    path, out, late, checkpoint = (new_path(spark, n) for n in ("late-log", "counts", "late", "checkpoint"))
    lines = extended_lines(spark, d)
    for part, rows in enumerate((lines.filter(F.dayofmonth("ts") > 15),
                                 lines.filter(F.dayofmonth("ts") <= 15))):
        rows.select("value").write.text(f"{path}/part={part}")
        started = running.count_intervals(tail.tail_records(spark, f"{path}/*"), ["cdn_region"], out, late,
                                          checkpoint, "1 hour")
        started.awaitTermination()
        if started.exception() is not None:
            raise started.exception()
    kept = running.late_rows(spark, late).groupBy(F.window("ts", "1 hour").start.alias("window_start"), "cdn_region").agg(
        F.count("*").alias("requests"), F.lit("late").alias("kind"))
    closed = running.interval_values(spark, out, ["cdn_region"], "1 hour").withColumn("kind", F.lit("closed"))
    return closed.unionByName(kept).withColumn("window_start", utc(c("window_start")))


@query("json_debug_sink_s17", """SELECT method, path, status, size AS body_bytes_sent, cache_status, cdn_region,
    lat, request_time FROM accesses""")
def json_debug_sink(spark, d):
    out, checkpoint = new_path(spark, "json"), new_path(spark, "checkpoint")
    _in_two_parts(spark, d, lambda p: tail.json_debug(tail.tail_records(spark, p), out, checkpoint))
    schema = ("method STRING, path STRING, status INT, body_bytes_sent BIGINT, cache_status STRING, "
              "cdn_region STRING, lat DOUBLE, request_time DOUBLE")
    return spark.read.schema(schema).json(out)
