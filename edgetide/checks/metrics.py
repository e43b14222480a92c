"""Checks of counters, histograms, intervals and edge audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.views import accesses, extended_lines, probes, records
from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths
from edgetide.operators import audits, counters, rate_limits, traffic
from edgetide.plans import metrics as metric_plan
from edgetide.sources import access_logs

c = F.col


def r6(name):
    return F.round(c(name), 6).alias(name)


def _parsed(spark, d):
    """Records through the extended parser and the request split."""
    lines = extended_lines(spark, d).select("value")
    return access_logs.split_request(access_logs.parse_extended(lines))


@query("requests_total_a10", """SELECT method, status, cache_status, cdn_region,
    count(*) AS requests FROM accesses GROUP BY ALL""")
def requests_total(spark, d):
    return counters.requests_total(_parsed(spark, d))


@query("bytes_total_a11", """SELECT method, status, cache_status, CAST(sum(size) AS BIGINT)
    AS bytes_sent FROM accesses GROUP BY ALL""")
def bytes_total(spark, d):
    return counters.bytes_total(_parsed(spark, d))


def histogram_sql(labels: str, value: str) -> str:
    bounds = ", ".join(f"('{b}', {b}::DOUBLE)" for b in fixed.HISTOGRAM_BOUNDS)
    return f"""
    WITH bounds(le, b) AS (VALUES {bounds}, ('+Inf', 'Infinity'::DOUBLE)),
    wide AS (SELECT {labels}, list({value}) AS v, coalesce(count({value}), 0) AS n,
      round(sum({value}), 6) AS s FROM accesses GROUP BY ALL)
    SELECT {labels}, le, CAST(len(list_filter(v, lambda x: x <= b)) AS BIGINT) AS bucket,
      s AS value_sum, n AS value_count FROM wide, bounds"""


@query("duration_histogram_a12", histogram_sql("method, status, cache_status", "request_time"))
def duration_histogram(spark, d):
    return counters.duration_histogram(_parsed(spark, d)).withColumn(
        "value_sum", F.round("value_sum", 6))


@query("latency_histogram_a13", histogram_sql("method, status, cdn_region", "lat").replace(
    "list(lat)", "list(lat) FILTER (lat IS NOT NULL)").replace("len(list_filter(v", "len(list_filter(coalesce(v, [])"))
def latency_histogram(spark, d):
    return counters.latency_histogram(_parsed(spark, d)).withColumn(
        "value_sum", F.round("value_sum", 6))


@query("status_total_a14", """SELECT method, status, path, count(*) AS requests
    FROM accesses GROUP BY ALL""")
def status_total(spark, d):
    return counters.status_total(_parsed(spark, d))


@query("cache_status_total_a15", """SELECT method, status, cache_status, cdn_region,
    count(*) AS requests FROM accesses GROUP BY ALL""")
def cache_status_total(spark, d):
    return counters.cache_status_total(_parsed(spark, d))


@query("cache_requests_a16", """SELECT cache_status, cdn_region, method,
    count(*) AS requests FROM accesses GROUP BY ALL""")
def cache_requests(spark, d):
    return counters.cache_requests(_parsed(spark, d))


@query("hit_ratio_a16", """SELECT cdn_region, method, count(*) FILTER (cache_status = 'HIT') AS hits,
    count(*) AS requests, round(count(*) FILTER (cache_status = 'HIT') / count(*), 6) AS hit_ratio
    FROM accesses GROUP BY ALL""")
def hit_ratio(spark, d):
    return counters.hit_ratio(records(spark, d)).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query("interval_samples_x3", """SELECT time_bucket(INTERVAL '10 seconds', ts) AS window_start,
    cdn_region, status, count(*) AS requests FROM accesses GROUP BY ALL""")
def interval_samples(spark, d):
    return counters.sampled(records(spark, d), ["cdn_region", "status"])


@query("sliding_rate_x4", """
    WITH steps AS (SELECT time_bucket(INTERVAL '1 minute', ts) AS s, cdn_region, count(*) AS n
      FROM accesses GROUP BY ALL)
    SELECT s - to_minutes(CAST(m AS INTEGER)) AS window_start, cdn_region,
      CAST(sum(n) AS BIGINT) AS requests, round(sum(n) / 300.0, 6) AS per_second
    FROM steps, (SELECT unnest(range(5)) AS m) GROUP BY ALL""")
def sliding_rate(spark, d):
    return counters.sliding_rate(records(spark, d), ["cdn_region"]).withColumn(
        "per_second", F.round("per_second", 6))


@query("residency_sessions_x5", """
    WITH marked AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL '1 hour' AS fresh FROM accesses
      WINDOW w AS (PARTITION BY cdn_region, file_id ORDER BY ts)),
    numbered AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (
      PARTITION BY cdn_region, file_id ORDER BY ts) AS s FROM marked)
    SELECT cdn_region, file_id, min(ts) AS session_start, max(ts) AS last_access,
      count(*) AS accesses FROM numbered GROUP BY cdn_region, file_id, s""")
def residency_sessions(spark, d):
    return audits.residency(accesses(spark, d), 3600).select(
        "cdn_region", "file_id", "session_start", "last_access", "accesses")


@query("residency_sessions_week_x5", """
    WITH marked AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL '7 days' AS fresh FROM accesses
      WINDOW w AS (PARTITION BY cdn_region, file_id ORDER BY ts)),
    numbered AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (
      PARTITION BY cdn_region, file_id ORDER BY ts) AS s FROM marked)
    SELECT cdn_region, file_id, min(ts) AS session_start, max(ts) AS last_access,
      count(*) AS accesses FROM numbered GROUP BY cdn_region, file_id, s""")
def residency_sessions_week(spark, d):
    return audits.residency(accesses(spark, d), fixed.RESIDENCY_SECONDS["media"]).select(
        "cdn_region", "file_id", "session_start", "last_access", "accesses")


@query("freshness_x6", """
    WITH prev AS (SELECT event_id, cdn_region, file_id, lag(status) OVER w AS prev_status,
      (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS age FROM accesses
      WINDOW w AS (PARTITION BY cdn_region, file_id ORDER BY ts, event_id))
    SELECT event_id, prev_status, round(age, 6) AS age_seconds, age > CASE prev_status WHEN 200 THEN 2592000
      WHEN 304 THEN 2592000 WHEN 404 THEN 60 END AS stale FROM prev WHERE prev_status IS NOT NULL""")
def freshness(spark, d):
    return audits.freshness(accesses(spark, d), "event_id", "media").select(
        "event_id", "prev_status", F.round("age_since_last_access", 6).alias("age_seconds"), "stale")


@query("over_rate_x7", """SELECT ip, date_trunc('minute', ts) AS slot, count(*) AS requests
    FROM accesses GROUP BY ALL HAVING count(*) > 1""")
def over_rate(spark, d):
    """The audit with a lower rate and a longer slot, so that the sparse trace exceeds it."""
    return audits.over_rate(accesses(spark, d), rate=1, burst=0, slot="1 minute")


@query("over_rate_zones_x7", """SELECT (SELECT count(*) FROM accesses) AS requests, count(*) AS violations
    FROM (SELECT ip FROM accesses GROUP BY ip, date_trunc('second', ts) HAVING count(*) > 70)""")
def over_rate_zones(spark, d):
    """Client seconds above the media zone's own limit, beside all requests."""
    rows = accesses(spark, d)
    found = audits.over_rate(rows, *fixed.RATE_ZONES["media"])
    return rows.agg(F.count("*").alias("requests")).withColumn(
        "violations", found.select(F.count("*")).scalar())


#: The trace replayed this many times faster, so that single clients come near the edge's limits.
SPEED = 20_000_000
START = "2024-01-01 00:00:00"


def _bucket_sql(result: str) -> str:
    """One request instant after the other, all clients side by side."""
    media, api = fixed.RATE_ZONES["media"], fixed.RATE_ZONES["api"]
    return f"""
    WITH RECURSIVE fast AS (SELECT ip, CASE file_type WHEN 'image' THEN 'media' ELSE 'api' END AS zone,
      (epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) // {SPEED * 1000} AS ms FROM accesses),
    instants AS (SELECT zone, ip, ms, count(*) AS n FROM fast GROUP BY ALL),
    steps AS (SELECT *, row_number() OVER w AS i, ms - lag(ms) OVER w AS gap,
      CASE zone WHEN 'media' THEN {media[0]} ELSE {api[0]} END AS rate,
      CASE zone WHEN 'media' THEN {media[1] * 1000} ELSE {api[1] * 1000} END AS burst
      FROM instants WINDOW w AS (PARTITION BY zone, ip ORDER BY ms)),
    bucket AS (
      SELECT zone, ip, i, ms, n, least(n, (burst + 1000) // 1000) AS ok,
        -1000 + 1000 * least(n, (burst + 1000) // 1000) AS level FROM steps WHERE i = 1
      UNION ALL
      SELECT zone, ip, i, ms, n, least(n, (burst - drained) // 1000),
        drained + 1000 * least(n, (burst - drained) // 1000)
      FROM (SELECT s.*, greatest(-1000, b.level - s.rate * s.gap) AS drained
        FROM bucket b JOIN steps s ON s.zone = b.zone AND s.ip = b.ip AND s.i = b.i + 1)),
    replayed AS (SELECT zone, ip, TIMESTAMP '{START}' + to_milliseconds(ms) AS instant, CAST(n AS BIGINT) AS requests,
      CAST(ok AS BIGINT) AS accepted, CAST(n - ok AS BIGINT) AS refused, CAST(level AS BIGINT) AS level FROM bucket)
    {result}"""


def _limited(spark, d):
    """The edge's own limits on the faster trace; images in one zone, videos in the other."""
    start = F.lit(START).cast("timestamp_ntz")
    millis = F.floor((paths.epoch_micros(c("ts")) - paths.epoch_micros(start)) / (SPEED * 1000))
    rows = accesses(spark, d).select(
        "ip", F.when(c("file_type") == "image", "media").otherwise("api").alias("zone"),
        paths.at_millis(paths.epoch_millis(start) + millis).alias("ts"))
    return rate_limits.leaky_bucket(rows, fixed.RATE_ZONES)


@query("leaky_bucket_x7", _bucket_sql("SELECT * FROM replayed"))
def leaky_bucket(spark, d):
    return _limited(spark, d)


@query("refused_clients_x7", _bucket_sql("""
    SELECT zone, ip, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(refused) AS BIGINT) AS refused,
      min(CASE WHEN refused > 0 THEN instant END) AS first_refused,
      max(CASE WHEN refused > 0 THEN instant END) AS last_refused,
      round(sum(refused) / sum(requests), 6) AS share
    FROM replayed GROUP BY zone, ip HAVING sum(refused) > 0"""))
def refused_clients(spark, d):
    return rate_limits.refused_clients(_limited(spark, d)).withColumn("share", F.round("share", 6))


@query("availability_a33", """SELECT time_bucket(INTERVAL '30 seconds', ts) AS slot, count(*) AS probes,
    round(avg(CASE WHEN status_code = '200' THEN 1.0 ELSE 0.0 END), 6) AS available
    FROM probes GROUP BY ALL""")
def availability(spark, d):
    return traffic.availability(probes(spark, d)).withColumn("available", F.round("available", 6))


@query("all_metrics_one_pass", """
    SELECT 'requests_total' AS metric, count(*) AS series, CAST(sum(n) AS DOUBLE) AS value FROM (
      SELECT count(*) AS n FROM accesses GROUP BY method, status, cache_status, cdn_region)
    UNION ALL SELECT 'bytes_total', count(*), sum(n) FROM (
      SELECT sum(size) AS n FROM accesses GROUP BY method, status, cache_status)
    UNION ALL SELECT 'duration', 11 * count(*), sum(n) FROM (
      SELECT count(request_time) AS n FROM accesses GROUP BY method, status, cache_status)
    UNION ALL SELECT 'latency', 11 * count(*), sum(n) FROM (
      SELECT count(lat) AS n FROM accesses GROUP BY method, status, cdn_region)
    UNION ALL SELECT 'status_total', count(*), sum(n) FROM (
      SELECT count(*) AS n FROM accesses GROUP BY method, status, path)
    UNION ALL SELECT 'cache_status_total', count(*), sum(n) FROM (
      SELECT count(*) AS n FROM accesses GROUP BY method, status, cache_status, cdn_region)
    UNION ALL SELECT 'cache_requests', count(*), sum(n) FROM (
      SELECT count(*) AS n FROM accesses GROUP BY cache_status, cdn_region, method)""")
def all_metrics_one_pass(spark, d):
    """Number of series and total per metric, all from one pass over the log."""
    out = None
    for name, rows in metric_plan.metric_tables(_parsed(spark, d)).items():
        value = ("bytes_sent" if name == "bytes_total"
                 else "bucket" if name in ("duration", "latency") else "requests")
        kept = c("le") == "+Inf" if value == "bucket" else F.lit(True)
        one = rows.agg(F.lit(name).alias("metric"), F.count("*").alias("series"),
                       F.sum(F.when(kept, c(value))).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
