"""Checks of the column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.views import (AS_OF, CDN, ORIGIN, accesses, content, plain_lines, predictions,
                                   snapshot, table)
from edgetide.functions import clients, paths, responses, scores
from edgetide.functions import fixed_values as fixed
from edgetide.operators import cleaning, snapshot as snapshots

c = F.col


def r6(column):
    return F.round(column, 6)


def sql_map(table_: dict, value: str, default: str) -> str:
    rows = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items())
    return f"CASE {value} {rows} ELSE {default} END"


CLASS_OF_EXT = {e: k for k, es in fixed.EXTENSIONS_BY_CLASS.items() for e in es}
EXT = "lower(regexp_extract({0}, '([^.]*)$', 1))"


@query("path_extension_p1", "SELECT page_id, " + EXT.format("url") + " AS extension FROM pages")
def path_extension(spark, d):
    return table(spark, d, "pages").select("page_id", paths.extension(c("url")).alias("extension"))


@query("object_id_p2", """SELECT page_id, split_part(regexp_extract(url, '([^/]*)$', 1), '.', 1)
                          AS object_id FROM pages""")
def object_id(spark, d):
    return table(spark, d, "pages").select("page_id", paths.object_id(c("url")).alias("object_id"))


@query("media_type_p3", "SELECT event_id, " + sql_map(fixed.MEDIA_TYPE_BY_EXTENSION,
       EXT.format("path"), "'other'") + " AS media_type FROM accesses")
def media_type(spark, d):
    return accesses(spark, d).select("event_id", paths.media_type(c("path")).alias("media_type"))


_PATH = """CASE WHEN url LIKE 'http%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)
           ELSE url END"""


@query("content_class_p4", f"""
    SELECT page_id, CASE WHEN path NOT LIKE '%.%' THEN 'unknown' ELSE
      {sql_map(CLASS_OF_EXT, EXT.format('path'), "'other'")} END AS content_class
    FROM (SELECT page_id, {_PATH} AS path FROM pages)""")
def content_class(spark, d):
    return table(spark, d, "pages").select("page_id",
                                           paths.content_class(c("url")).alias("content_class"))


_LABELS = {**CLASS_OF_EXT, **{n: n for n in fixed.CLASS_NAMES_ACCEPTED_AS_LABELS}}
_ALL_LABELS = {**_LABELS, **{n: n for n in fixed.CLASS_ORDINAL if n not in ("other", "unknown")}}


@query("class_of_label_p5", f"""
    SELECT event_id, {sql_map(_LABELS, 'file_type', "'other'")} AS strict_class,
      {sql_map(_ALL_LABELS, 'file_type', "'other'")} AS class,
      {sql_map(_ALL_LABELS, EXT.format('path'), "'other'")} AS ext_class FROM accesses""")
def class_of_label(spark, d):
    return accesses(spark, d).select(
        "event_id", paths.class_of_label(c("file_type"), strict=True).alias("strict_class"),
        paths.class_of_label(c("file_type")).alias("class"),
        paths.class_of_label(paths.extension(c("path"))).alias("ext_class"))


@query("class_from_label_or_id_p6", """
    SELECT event_id, file_type AS by_label, 'unknown' AS by_id FROM accesses""")
def class_from_label_or_id(spark, d):
    rows = accesses(spark, d)
    labelled = cleaning.with_class(rows).select("event_id", c("type").alias("by_label"))
    unlabelled = cleaning.with_class(rows.withColumn("file_type", F.lit(None).cast("string")))
    return labelled.join(unlabelled.select("event_id", c("type").alias("by_id")), "event_id")


@query("client_class_p7", """
    SELECT event_id, CASE
      WHEN regexp_matches(lower(user_agent), 'mobile|android|iphone') THEN 'mobile'
      WHEN regexp_matches(lower(user_agent), 'tablet|ipad') THEN 'tablet'
      WHEN regexp_matches(lower(user_agent), 'chrome|firefox|safari|edge') THEN 'desktop'
      ELSE 'other' END AS client_class FROM accesses""")
def client_class(spark, d):
    return accesses(spark, d).select("event_id",
                                     clients.client_class(c("user_agent")).alias("client_class"))


@query("bot_flag_p8", """
    SELECT event_id, regexp_matches(lower(user_agent),
      'bot|crawler|spider|scraper|curl|wget|slurp') AS is_bot FROM accesses""")
def bot_flag(spark, d):
    return accesses(spark, d).select("event_id", clients.is_bot(c("user_agent")).alias("is_bot"))


@query("numeric_and_log_size_p9", """
    SELECT event_id, CAST(size AS DOUBLE) AS size, round(ln(1 + size), 6) AS log_file_size,
      0.0::DOUBLE AS bad_size FROM accesses""")
def numeric_and_log_size(spark, d):
    size = cleaning.numeric_size(c("size").cast("string"))
    return accesses(spark, d).select(
        "event_id", size.alias("size"), r6(F.log1p(size)).alias("log_file_size"),
        cleaning.numeric_size(c("file_id")).alias("bad_size"))


@query("serving_log_size_p10", """
    SELECT event_id, round(ln(1 + greatest(1, size)), 6) AS log_file_size FROM accesses""")
def serving_log_size(spark, d):
    return accesses(spark, d).select(
        "event_id", r6(scores.log_size_at_least_one(c("size"))).alias("log_file_size"))


@query("class_ordinal_p11", """
    SELECT event_id, CASE file_type WHEN 'image' THEN 2 WHEN 'video' THEN 0 ELSE 11 END
      AS ordinal, 11 AS missing FROM accesses""")
def class_ordinal(spark, d):
    return accesses(spark, d).select(
        "event_id", paths.class_ordinal(c("file_type")).alias("ordinal"),
        paths.class_ordinal(c("file_id")).alias("missing"))


@query("class_ordinal_join_j5", """
    SELECT event_id, CASE file_type WHEN 'image' THEN 2 WHEN 'video' THEN 0 ELSE 11 END
      AS ordinal FROM accesses""")
def class_ordinal_join(spark, d):
    # twelve fixed rows
    lookup = F.broadcast(spark.createDataFrame(list(fixed.CLASS_ORDINAL.items()),
                                               "file_type string, code int"))
    return (accesses(spark, d).join(lookup, "file_type", "left")
            .select("event_id", F.coalesce("code", F.lit(fixed.MISSING_CLASS_ORDINAL))
                    .alias("ordinal")))


@query("alphabetical_code_p12", """
    SELECT region, file_id, code FROM snapshot JOIN (
      SELECT type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT type FROM snapshot)) USING (type)""")
def alphabetical_code(spark, d):
    return snapshots.alphabetical_code(snapshot(spark, d), "type").select(
        "region", "file_id", "code")


@query("age_p13", """
    SELECT region, file_id, round(age_since_last_access, 6) AS seconds,
      round(age_hours, 6) AS hours, round(age_since_last_access / 86400, 6) AS days FROM featured""")
def age(spark, d):
    s = scores.age_seconds(c("last_access"), AS_OF)
    return snapshot(spark, d).select("region", "file_id", r6(s).alias("seconds"),
                                     r6(s / 3600).alias("hours"), r6(s / 86400).alias("days"))


@query("serving_features_p14", """
    SELECT region, file_id, round(access_count / greatest(age_hours, 0.1), 6) AS access_rate,
      round(1 / (1 + age_hours), 6) AS recency_score,
      round(size / (access_count + 1), 6) AS stack_distance_approx FROM featured""")
def serving_features(spark, d):
    return snapshots.serving_features(snapshot(spark, d), AS_OF).select(
        "region", "file_id", *[r6(c(n)).alias(n) for n in
                               ("access_rate", "recency_score", "stack_distance_approx")])


@query("alternative_features_p15", """
    SELECT region, file_id, round(access_count / (age_hours + 1), 6) AS access_rate,
      round(access_count / log2(age_hours + 2), 6) AS recency_score,
      round(size / (access_count + 1), 6) AS stack_distance_approx,
      round(age_hours / 24, 6) AS age_days FROM featured""")
def alternative_features(spark, d):
    return snapshots.alternative_features(snapshot(spark, d), AS_OF).select(
        "region", "file_id", *[r6(c(n)).alias(n) for n in (
            "access_rate", "recency_score", "stack_distance_approx", "age_days")])


@query("model_row_with_defaults_p16", """
    SELECT region, file_id, size, CASE type WHEN 'image' THEN 2 ELSE 0 END AS type_encoded,
      access_count, 0.0::DOUBLE AS age_since_last_access, 0.0::DOUBLE AS age_hours,
      round(ln(1 + size), 6) AS log_file_size, 1.0::DOUBLE AS access_rate,
      1.0::DOUBLE AS recency_score, 1000.0::DOUBLE AS stack_distance_approx FROM snapshot""")
def model_row_with_defaults(spark, d):
    bare = snapshot(spark, d).withColumn("type_encoded", paths.class_ordinal(c("type")))
    return snapshots.model_row(bare, keep=("region", "file_id")).withColumn(
        "log_file_size", r6(c("log_file_size")))


@query("count_estimate_by_age_and_size_p17", """
    SELECT region, file_id, CAST(greatest(1, floor(age_hours / 24 * 0.5
        + size / 1048576.0 * 0.1)) AS BIGINT) AS estimate,
      CAST(greatest(1, floor(age_hours / 24 * 0.2)) AS BIGINT) AS plain_estimate
    FROM featured""")
def count_estimate(spark, d):
    days = scores.age_seconds(c("last_access"), AS_OF) / 86400.0
    return snapshot(spark, d).select(
        "region", "file_id",
        scores.estimated_count_by_age_and_size(c("type"), days, c("size")).alias("estimate"),
        scores.estimated_count_by_age_and_size(F.lit("other"), days, c("size"))
        .alias("plain_estimate"))


@query("count_or_age_estimate_p18", """
    SELECT region, file_id, CAST(greatest(1, floor(1 + age_hours / 24 * 0.1)) AS BIGINT)
      AS estimate, access_count FROM featured""")
def count_or_age_estimate(spark, d):
    days = scores.age_seconds(c("last_access"), AS_OF) / 86400.0
    return snapshot(spark, d).select(
        "region", "file_id",
        scores.count_or_age_estimate(F.lit(None).cast("bigint"), days).alias("estimate"),
        scores.count_or_age_estimate(c("access_count"), days).alias("access_count"))


@query("underscore_count_p19", """
    SELECT event_id, CAST(length(file_id) - length(replace(file_id, '_', '')) AS INTEGER) AS underscores
    FROM accesses""")
def underscore_count(spark, d):
    return accesses(spark, d).select("event_id", paths.underscores(c("file_id")).alias("underscores"))


@query("class_whitelist_p20", """
    SELECT page_id, CASE WHEN s IN ('image', 'video') THEN s ELSE 'other' END AS kept FROM (
      SELECT page_id, ['image', 'video', 'font'][CAST(page_id % 3 AS INTEGER) + 1] AS s FROM pages)""")
def class_whitelist(spark, d):
    kind = F.element_at(F.array(F.lit("image"), F.lit("video"), F.lit("font")),
                        (c("page_id") % 3).cast("int") + 1)
    return table(spark, d, "pages").select("page_id", paths.keep_known_class(kind).alias("kept"))


_HASH = "md5('https://media_origin/media-bucket' || path)"


@query("cache_hash_p21", f"SELECT event_id, {_HASH} AS hash FROM accesses")
def cache_hash(spark, d):
    return accesses(spark, d).select("event_id", responses.cache_hash(c("path")).alias("hash"))


@query("hash_of_cached_path_p22", f"""
    SELECT event_id, right({_HASH}, 32) AS plain, right({_HASH}, 32) AS temporary FROM accesses""")
def hash_of_cached_path(spark, d):
    cached = responses.cached_path_of_hash(responses.cache_hash(c("path")))
    return accesses(spark, d).select(
        "event_id", responses.hash_of_cached_path(cached).alias("plain"),
        responses.hash_of_cached_path(F.concat(cached, F.lit(".0000000001"))).alias("temporary"))


@query("cached_path_p23", f"""
    SELECT event_id, right(h, 2) || '/' || substr(h, 29, 2) || '/' || h AS cached_path
    FROM (SELECT event_id, {_HASH} AS h FROM accesses)""")
def cached_path(spark, d):
    return accesses(spark, d).select("event_id", responses.cached_path_of_hash(
        responses.cache_hash(c("path"))).alias("cached_path"))


@query("cdn_url_p24", f"""
    SELECT id, replace(url, '{ORIGIN}', '{CDN}') AS active, url AS inactive,
      CASE WHEN id % 2 = 0 THEN replace(url, '{ORIGIN}', '{CDN}') ELSE url END AS mixed
    FROM content""")
def cdn_url(spark, d):
    return content(spark, d).select(
        "id", paths.cdn_url(c("url"), ORIGIN, CDN).alias("active"),
        paths.cdn_url(c("url"), ORIGIN, CDN, False).alias("inactive"),
        paths.cdn_url(c("url"), ORIGIN, CDN, c("id") % 2 == 0).alias("mixed"))


_LABEL = {"sea": "Southeast-Asia", "us-east": "US-East", "eu-west": "EU-West"}


@query("region_flag_p25", """
    SELECT event_id, CASE cdn_region WHEN 'eu-west' THEN '🇪🇺' WHEN 'sea' THEN '🇮🇩' ELSE '🇺🇸' END
      AS flag, '🌐' AS raw_flag FROM accesses""")
def region_flag(spark, d):
    return accesses(spark, d).select(
        "event_id", responses.region_flag(paths.one_of(c("cdn_region"), _LABEL)).alias("flag"),
        responses.region_flag(c("cdn_region")).alias("raw_flag"))


@query("cache_policy_p26", """
    SELECT event_id, kind, CASE kind WHEN 'media' THEN 'public, max-age=2592000'
        WHEN 'static' THEN 'public, max-age=2592000, immutable'
        WHEN 'page' THEN 'public, max-age=3060, stale-while-revalidate=10'
        WHEN 'api' THEN 'public, max-age=300' END AS policy,
      CASE kind WHEN 'page' THEN 3060 WHEN 'api' THEN 300 WHEN 'unset' THEN NULL
        ELSE 2592000 END AS max_age
    FROM (SELECT event_id, ['static', 'media', 'page', 'api', 'unset']
      [CAST(event_id % 5 AS INTEGER) + 1] AS kind FROM events)""")
def cache_policy(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("static", "media", "page", "api", "unset")])
    kind = F.element_at(kinds, (c("event_id") % 5).cast("int") + 1)
    return table(spark, d, "events").select(
        "event_id", kind.alias("kind"), responses.cache_policy(kind).alias("policy"),
        responses.policy_max_age(kind).alias("max_age"))


@query("weak_etag_p27", """
    SELECT page_id, 'W/"' || substr(md5(html), 1, 16) || '"' AS etag FROM pages""")
def weak_etag(spark, d):
    return table(spark, d, "pages").select("page_id", responses.weak_etag(c("html")).alias("etag"))


@query("versioned_url_p28", """
    SELECT id, url || '?v=' || (epoch_us(uploaded_at) // 1000000) AS url FROM content""")
def versioned_url(spark, d):
    return content(spark, d).select("id", paths.versioned_url(c("url"), c("uploaded_at"))
                                    .alias("url"))


@query("route_class_p29", """
    SELECT page_id, CASE
      WHEN regexp_matches(path, '(?i)^/static/(images|videos|uploads)/') THEN 'static_media'
      WHEN regexp_matches(path, '/\\.([^w]|w[^e]|$)') THEN 'hidden'
      WHEN regexp_matches(path, '(?i)env\\.json$') THEN 'env_file'
      WHEN path LIKE '/health%' THEN 'health' ELSE 'page' END AS route
    FROM (SELECT page_id, ['/static/images/', '/.git/', '/.well-known/', '/health/', '/conf/env.json#', '/en/']
      [CAST(page_id % 6 AS INTEGER) + 1] || page_id AS raw, replace(
        ['/static/images/', '/.git/', '/.well-known/', '/health/', '/conf/env.json', '/en/']
        [CAST(page_id % 6 AS INTEGER) + 1] || page_id, 'env.json' || page_id, 'env.json') AS path FROM pages)""")
def route_class(spark, d):
    heads = ["/static/images/", "/.git/", "/.well-known/", "/health/", "/conf/env.json", "/en/"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (c("page_id") % 6).cast("int") + 1)
    path = F.when(head == "/conf/env.json", head).otherwise(F.concat(head, "page_id"))
    return table(spark, d, "pages").select("page_id", paths.route_class(path).alias("route"))


@query("url_category_p30", r"""
    SELECT page_id, regexp_replace(url, 'https?://[^/]+/([^/]+/[^/]+).*', '\1') AS category
    FROM pages""")
def url_category(spark, d):
    return table(spark, d, "pages").select("page_id", paths.url_category(c("url")).alias("category"))


@query("hour_and_load_band_p31_p32", """
    SELECT event_id, h AS hour, CAST(CASE WHEN h <= 6 THEN 0.3 WHEN h <= 8 THEN 0.8 WHEN h <= 11 THEN 1.5
      WHEN h <= 13 THEN 1.2 WHEN h <= 17 THEN 1.8 WHEN h <= 19 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS multiplier
    FROM (SELECT event_id, CAST(hour(ts) AS INTEGER) AS h FROM events)""")
def hour_and_load_band(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.hour("ts").alias("hour"),
        responses.load_multiplier(F.hour("ts")).alias("multiplier"))


@query("group_title_p33", """
    SELECT id, array_to_string(list_transform(string_split("group", '-'),
      lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM content""")
def group_title(spark, d):
    return content(spark, d).select("id", paths.group_title(c("group")).alias("title"))


@query("render_log_line_p34", "SELECT event_id, value FROM plain_lines")
def render_log_line(spark, d):
    return plain_lines(spark, d).select("event_id", "value")


@query("missing_features_u5", """SELECT count(*) AS rows,
    'access_rate,age_hours,age_since_last_access,log_file_size,recency_score,stack_distance_approx,type_encoded'
      AS bare_lacks, '' AS full_lacks FROM snapshot""")
def missing_features(spark, d):
    """Which model columns the bare and the enriched snapshot lack, beside their sizes."""
    bare = snapshot(spark, d)
    full = predictions(spark, d)
    return bare.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(",".join(snapshots.missing_features(bare))).alias("bare_lacks"),
        F.lit(",".join(snapshots.missing_features(full))).alias("full_lacks"))
