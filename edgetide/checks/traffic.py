"""Checks of the traffic report and the popularity model."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.views import accesses, probes, table
from edgetide.operators import traffic
from edgetide.plans import report

c = F.col


@query("probe_totals_a17", """SELECT count(*) AS total_requests,
    count(*) FILTER (try_cast(status_code AS INTEGER) BETWEEN 200 AND 399) AS successful_requests,
    count(*) FILTER (status_code = 'FAILED') AS failed_requests FROM probes""")
def probe_totals(spark, d):
    return traffic.totals(probes(spark, d))


@query("success_rate_a18", """
    WITH t AS (SELECT (SELECT count(*) FROM good_probes) AS s, (SELECT count(*) FROM probes) AS n)
    SELECT CAST((s * 10000 // n) / 100 AS DOUBLE) AS success_rate,
      CAST((s * 1000 // n) / 10 AS DOUBLE) AS success_rate_short FROM t""")
def success_rate(spark, d):
    return traffic.success_rate(probes(spark, d))


@query("category_counts_a19", r"""
    SELECT regexp_replace(url, 'https?://[^/]+/([^/]+/[^/]+).*', '\1') AS category,
      count(*) AS requests FROM good_probes GROUP BY ALL""")
def category_counts(spark, d):
    return traffic.category_counts(probes(spark, d))


@query("kind_counts_a20", """
    WITH k AS (SELECT CASE WHEN url LIKE '%.jpg%' THEN 'Images' WHEN url LIKE '%.mp4%' THEN 'Videos'
      ELSE 'Other' END AS kind FROM good_probes),
    n AS (SELECT kind, count(k.kind) AS requests FROM (VALUES ('Images'), ('Videos'), ('Other')) v(kind)
      LEFT JOIN k USING (kind) GROUP BY ALL)
    SELECT kind, requests, CAST((requests * 1000 // (SELECT count(*) FROM k)) / 10 AS DOUBLE) AS percent
    FROM n""")
def kind_counts(spark, d):
    return traffic.kind_counts(probes(spark, d))


@query("response_times_a21", """SELECT round(avg(response_time), 6) AS mean,
    round(median(response_time), 6) AS median, min(response_time) AS least,
    max(response_time) AS greatest FROM good_probes""")
def response_times(spark, d):
    return traffic.response_times(probes(spark, d)).select(
        F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "least", "greatest")


@query("response_times_approximate_a21")
def response_times_approximate(spark, d):
    return traffic.response_times_approximate(probes(spark, d))


@query("hourly_requests_a22", """SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS requests
    FROM good_probes GROUP BY ALL""")
def hourly_requests(spark, d):
    return traffic.hourly(probes(spark, d))


@query("hourly_load_p32", """SELECT h AS hour, n AS requests, CAST(CASE WHEN h <= 6 THEN 0.3 WHEN h <= 8 THEN 0.8
    WHEN h <= 11 THEN 1.5 WHEN h <= 13 THEN 1.2 WHEN h <= 17 THEN 1.8 WHEN h <= 19 THEN 2.0
    ELSE 1.0 END AS DOUBLE) AS multiplier FROM (SELECT CAST(hour(ts) AS INTEGER) AS h, count(*) AS n
    FROM accesses GROUP BY ALL)""")
def hourly_load(spark, d):
    return traffic.hourly_load(accesses(spark, d))


@query("top_urls_k7", """SELECT url, count(*) AS requests FROM good_probes GROUP BY ALL
    ORDER BY requests DESC, url LIMIT 20""")
def top_urls(spark, d):
    return traffic.top_urls(probes(spark, d))


@query("most_popular_url_k7", """SELECT url, count(*) AS requests FROM good_probes GROUP BY ALL
    ORDER BY requests DESC, url LIMIT 1""")
def most_popular_url(spark, d):
    return traffic.top_urls(probes(spark, d), 1)


@query("zipf_ranks_w13", """SELECT url, requests, row_number() OVER (ORDER BY requests DESC, url)
    AS rank FROM (SELECT url, count(*) AS requests FROM good_probes GROUP BY ALL)""")
def zipf_ranks(spark, d):
    return traffic.rank_frequency(traffic.url_counts(probes(spark, d)))


@query("zipf_top_ranks_k8", """SELECT url, requests, CAST(row_number() OVER (ORDER BY requests DESC, url)
    AS INTEGER) AS rank FROM (SELECT url, count(*) AS requests FROM good_probes GROUP BY ALL)
    ORDER BY rank LIMIT 50""")
def zipf_top_ranks(spark, d):
    return traffic.rank_frequency(traffic.url_counts(probes(spark, d)), top=50)


@query("zipf_exponent_w15", """SELECT round(-regr_slope(ln(requests), ln(rank)), 6) AS exponent FROM (
    SELECT requests, row_number() OVER (ORDER BY requests DESC, url) AS rank
    FROM (SELECT url, count(*) AS requests FROM good_probes GROUP BY ALL))""")
def zipf_exponent(spark, d):
    counts = traffic.url_counts(probes(spark, d))
    return traffic.zipf_exponent(counts).select(F.round("exponent", 6).alias("exponent"))


@query("zipf_weights_w15", """SELECT path, round(CASE file_type WHEN 'image' THEN 6.0 ELSE 5.0 END
    / pow(n + 1, 1.2), 6) AS weight FROM (SELECT DISTINCT path, file_type,
      CASE WHEN k < 50 THEN k ELSE k - 50 END AS n FROM accesses)""")
def zipf_weights(spark, d):
    return _weights(spark, d).select("path", F.round("weight", 6).alias("weight"))


def _weights(spark, d):
    """Distinct objects of the trace with their Zipf weight by number within the kind."""
    number = F.when(c("k") < 50, c("k")).otherwise(c("k") - 50) + 1
    objects = accesses(spark, d).select("path", "file_id", "file_type", number.alias("n")).distinct()
    return objects.withColumn("weight", traffic.zipf_weight(c("file_type"), c("n")))


_CATALOGUE = """WITH w AS (SELECT DISTINCT path, file_id, CASE file_type WHEN 'image' THEN 6.0 ELSE 5.0 END
    / pow(CASE WHEN k < 50 THEN k ELSE k - 50 END + 1, 1.2) AS weight FROM accesses),
  cum AS (SELECT path, file_id, weight, weight / sum(weight) OVER () AS prob,
    sum(weight) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) / sum(weight) OVER () AS cum_prob FROM w)"""


@query("cumulative_probability_w14", _CATALOGUE + """SELECT path, round(prob, 6) AS prob,
    round(cum_prob, 6) AS cum_prob FROM cum""")
def cumulative_probability(spark, d):
    return traffic.cumulative_probability(_weights(spark, d), ["path"]).select(
        "path", F.round("prob", 6).alias("prob"), F.round("cum_prob", 6).alias("cum_prob"))


@query("total_weight_a31", """SELECT round(sum(weight), 6) AS total_weight FROM (SELECT DISTINCT path,
    CASE file_type WHEN 'image' THEN 6.0 ELSE 5.0 END
    / pow(CASE WHEN k < 50 THEN k ELSE k - 50 END + 1, 1.2) AS weight FROM accesses)""")
def total_weight(spark, d):
    return _weights(spark, d).agg(F.round(F.sum("weight"), 6).alias("total_weight"))


@query("drawn_items_j7", _CATALOGUE + """,
    draws AS (SELECT event_id, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 13) AS BIGINT)
      / 4503599627370496.0 AS u FROM events)
    SELECT event_id, path FROM draws ASOF JOIN cum ON u <= cum_prob""")
def drawn_items(spark, d):
    draws = table(spark, d, "events").select("event_id",
                                             traffic.uniform_draw(c("event_id")).alias("u"))
    items = traffic.cumulative_probability(_weights(spark, d), ["path"])
    return traffic.draw_items(draws, items, "path").select("event_id", "path")


@query("first_catalogue_items_k9", _CATALOGUE + """SELECT path, round(prob, 6) AS prob FROM cum
    ORDER BY path LIMIT 20""")
def first_catalogue_items(spark, d):
    items = traffic.cumulative_probability(_weights(spark, d), ["path"])
    return items.orderBy("path").limit(20).select("path", F.round("prob", 6).alias("prob"))


@query("trend_boost_j8", _CATALOGUE + """,
    days AS (SELECT DISTINCT file_id, CAST(dayofmonth(ts) AS INTEGER) AS day FROM accesses),
    ranked AS (SELECT file_id, day, row_number() OVER (PARTITION BY day ORDER BY md5(file_id || day)) AS r
      FROM days WHERE day IN (2, 4, 6))
    SELECT file_id, day, round(weight * CASE WHEN r <= 10 THEN 5 ELSE 1 END, 6) AS weight
    FROM days JOIN w USING (file_id) LEFT JOIN ranked USING (file_id, day)""")
def trend_boost(spark, d):
    from pyspark.sql.window import Window
    days = accesses(spark, d).select("file_id", F.dayofmonth("ts").alias("day")).distinct()
    order = Window.partitionBy("day").orderBy(F.md5(F.concat("file_id", "day").cast("binary")))
    schedule = (days.filter(c("day").isin(2, 4, 6)).withColumn("r", F.row_number().over(order))
                .filter(c("r") <= 10))
    weights = _weights(spark, d).select("file_id", "weight")
    return traffic.boosted_weights(weights, schedule, days).select(
        "file_id", "day", F.round("weight", 6).alias("weight"))


@query("catalogue_union_u2", """
    SELECT 'https://site.example/' || "group" AS url, CAST(count(*) AS DOUBLE) AS weight
      FROM content WHERE "group" <> '' GROUP BY ALL
    UNION ALL SELECT DISTINCT 'https://cdn.example' || path, round(CASE file_type WHEN 'image' THEN 6.0
      ELSE 5.0 END / pow(CASE WHEN k < 50 THEN k ELSE k - 50 END + 1, 1.2), 6) FROM accesses""")
def catalogue_union(spark, d):
    from edgetide.checks.views import CDN, content
    pages = (content(spark, d).filter(c("group") != "")
             .groupBy(F.concat(F.lit("https://site.example/"), "group").alias("url"))
             .agg(F.count("*").cast("double").alias("weight")))
    weights = _weights(spark, d).select(
        "file_type", F.concat(F.lit(CDN), "path").alias("url"), F.round("weight", 6).alias("weight"))
    images = weights.filter(c("file_type") == "image").drop("file_type")
    videos = weights.filter(c("file_type") == "video").drop("file_type")
    return pages.unionByName(images).unionByName(videos)


@query("object_days_a29", """SELECT file_id, CAST(ts AS DATE) AS day, count(*) AS requests
    FROM accesses GROUP BY ALL""")
def object_days(spark, d):
    return traffic.per_day(accesses(spark, d))


@query("object_day_matrix_a29", """
    WITH d AS (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day
      FROM accesses),
    o AS (SELECT DISTINCT file_id FROM accesses),
    n AS (SELECT file_id, ts::DATE AS day, count(*) AS n FROM accesses GROUP BY ALL)
    SELECT o.file_id, CAST((SELECT min(day) FROM d) AS VARCHAR) AS first_day,
      string_agg(CAST(coalesce(n.n, 0) AS VARCHAR), ',' ORDER BY d.day) AS counts
    FROM o CROSS JOIN d LEFT JOIN n ON n.file_id = o.file_id AND n.day = d.day GROUP BY o.file_id""")
def object_day_matrix(spark, d):
    return traffic.per_day_matrix(accesses(spark, d)).select(
        "file_id", F.col("first_day").cast("string").alias("first_day"), F.array_join("counts", ",").alias("counts"))


_KIND = """CASE WHEN url LIKE '%.jpg%' THEN 'Images' WHEN url LIKE '%.mp4%' THEN 'Videos' ELSE 'Other' END"""


@query("traffic_report_s18", r"""
    WITH u AS (SELECT url, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, url) AS r
      FROM good_probes GROUP BY url),
    s AS (SELECT (SELECT count(*) FROM good_probes) AS ok, (SELECT count(*) FROM probes) AS whole),
    k AS (SELECT kind, count(x.kind) AS n FROM (VALUES ('Images'), ('Videos'), ('Other')) v(kind)
      LEFT JOIN (SELECT """ + _KIND + r""" AS kind FROM good_probes) x USING (kind) GROUP BY ALL),
    t AS (SELECT avg(response_time) AS mean, median(response_time) AS median, min(response_time) AS least,
      max(response_time) AS greatest FROM good_probes),
    rows AS (
      SELECT 'statistics' AS section, 'total_requests' AS item, whole AS value FROM s
      UNION ALL SELECT 'statistics', 'successful_requests', ok FROM s
      UNION ALL SELECT 'statistics', 'failed_requests', count(*) FROM probes WHERE status_code = 'FAILED'
      UNION ALL SELECT 'success_rate', 'success_rate', (ok * 10000 // whole) / 100 FROM s
      UNION ALL SELECT 'success_rate', 'success_rate_short', (ok * 1000 // whole) / 10 FROM s
      UNION ALL SELECT 'top_urls', url, n FROM u WHERE r <= 20
      UNION ALL SELECT 'categories', regexp_replace(url, 'https?://[^/]+/([^/]+/[^/]+).*', '\1'), count(*)
        FROM good_probes GROUP BY ALL
      UNION ALL SELECT 'kinds', kind, n FROM k
      UNION ALL SELECT 'response_times', 'mean', mean FROM t UNION ALL SELECT 'response_times', 'median', median FROM t
      UNION ALL SELECT 'response_times', 'least', least FROM t UNION ALL SELECT 'response_times', 'greatest', greatest FROM t
      UNION ALL SELECT 'zipf', r || ',' || url, n FROM u WHERE r <= 50
      UNION ALL SELECT 'hourly', h, count(*) FROM (SELECT CAST(hour(ts) AS VARCHAR) AS h FROM good_probes) GROUP BY h)
    SELECT section, item, round(CAST(value AS DOUBLE), 6) AS value FROM rows""")
def traffic_report(spark, d):
    """All sections, written as one table with a folder per section and read back."""
    return report.written_report(probes(spark, d)).withColumn("value", F.round("value", 6))
