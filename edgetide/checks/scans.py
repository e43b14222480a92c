"""Checks of scans, sinks, filters, joins and the catalogue.

Scans read text, CSV or JSON that Spark has just written from the given tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.views import (CDN, ORIGIN, REGIONS, accesses, content, extended_lines,
                                   plain_lines, probes, snapshot, table)
from edgetide.functions import clients, paths, responses
from edgetide.operators import cleaning, content as contents, snapshot as snapshots
from edgetide.sources import access_logs, cache_indexes, catalogue, probes as probe_logs
from edgetide.staging import new_path

c = F.col


def _written_text(df, label):
    path = new_path(df.sparkSession, label)
    df.select("value").write.text(path)
    return path


def _noisy(lines):
    """Lines with other extensions, bad dates and named users among the good ones."""
    n = c("event_id")
    value = (F.when(n % 17 == 0, F.replace("value", F.lit(".jpg"), F.lit(".css")))
             .when(n % 19 == 0, F.regexp_replace("value", r"\[\d\d/Jan", "[99/Foo"))
             .when(n % 23 == 0, F.replace("value", F.lit(" - - "), F.lit(" - bob ")))
             .when(n % 29 == 0, F.replace("value", F.lit(" HTTP/1.1"), F.lit("")))
             .when(n % 31 == 0, F.replace("value", F.lit(".mp4 "), F.lit(".MP4 ")))
             .otherwise(c("value")))
    return lines.withColumn("value", value)


_NOISY = r"""CASE WHEN event_id % 17 = 0 THEN replace(value, '.jpg', '.css')
  WHEN event_id % 19 = 0 THEN regexp_replace(value, '\[\d\d/Jan', '[99/Foo')
  WHEN event_id % 23 = 0 THEN replace(value, ' - - ', ' - bob ')
  WHEN event_id % 29 = 0 THEN replace(value, ' HTTP/1.1', '')
  WHEN event_id % 31 = 0 THEN replace(value, '.mp4 ', '.MP4 ') ELSE value END"""
_PLAIN = (r"""'^([\d.]+) - - \[([^\]]+)\] "(\w+) ([^ ]+) HTTP/[\d.]+" (\d{3}) (\d+) """
          r""""([^"]*)" "([^"]*)"'""")
_PARSED = f"""
WITH noisy AS (SELECT {_NOISY} AS line FROM plain_lines),
g AS (SELECT regexp_extract(line, {_PLAIN},
  ['ip', 'time', 'method', 'path', 'status', 'size', 'referrer', 'agent']) AS g FROM noisy
  WHERE regexp_matches(line, {_PLAIN})),
parsed AS (SELECT g.ip AS ip, try_strptime(g.time, '%d/%b/%Y:%H:%M:%S +0000') AS ts,
  g.path AS url, split_part(regexp_extract(g.path, '([^/]*)$', 1), '.', 1) AS file_id,
  CASE lower(regexp_extract(g.path, '([^.]*)$', 1)) WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video'
    ELSE 'other' END AS file_type, CAST(g.status AS INTEGER) AS status,
  CAST(g.size AS BIGINT) AS size, g.referrer AS referrer, g.agent AS user_agent FROM g),
kept AS (SELECT * FROM parsed WHERE file_type <> 'other' AND ts IS NOT NULL)
"""


@query("plain_log_scan_s1", _PARSED + "SELECT * FROM kept")
def plain_log_scan(spark, d):
    path = _written_text(_noisy(plain_lines(spark, d)), "plain-log")
    return access_logs.parse_plain(access_logs.read_lines(spark, path))


@query("top_objects_from_log", _PARSED + """
    SELECT file_id, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes_sent FROM (
      SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM kept
      WHERE status IN (200, 304) AND NOT lower(user_agent) LIKE '%bot%')
    WHERE n >= 2 GROUP BY file_id ORDER BY requests DESC, file_id LIMIT 20""")
def top_objects_from_log(spark, d):
    parsed = access_logs.parse_plain(_noisy(plain_lines(spark, d)).select("event_id", "value"))
    clean = cleaning.clean_accesses(parsed, "event_id")
    return (clean.groupBy("file_id")
            .agg(F.count("*").alias("requests"), F.sum("size").cast("bigint").alias("bytes_sent"))
            .orderBy(F.desc("requests"), "file_id").limit(20))


_EXT = (r"""'^([^ ]+) \S+ \S+ \[([^\]]+)\] "([^"]+)" (\d{3}) (\d+) "([^"]+)" "([^"]+)" \S+ """
        r"""cache_status=(\S+) cdn_region=(\S+) lat=(\S+) rt=(\S+)$'""")
_RECORDS = f"""
WITH noisy AS (SELECT {_NOISY} AS line FROM extended_lines),
g AS (SELECT regexp_extract(line, {_EXT}, ['addr', 'time', 'request', 'status', 'size', 'ref',
  'agent', 'cache', 'region', 'lat', 'rt']) AS g FROM noisy WHERE regexp_matches(line, {_EXT})),
records AS (SELECT g.addr AS remote_addr,
  try_strptime(g.time, '%d/%b/%Y:%H:%M:%S +0000') AS ts, g.request AS request,
  CAST(g.status AS INTEGER) AS status, CAST(g.size AS BIGINT) AS body_bytes_sent,
  g.ref AS http_referer, g.agent AS http_user_agent, g.cache AS cache_status,
  g.region AS cdn_region, try_cast(g.lat AS DOUBLE) AS lat, try_cast(g.rt AS DOUBLE) AS request_time
  FROM g)
"""


@query("extended_log_scan_s2", _RECORDS + "SELECT * FROM records")
def extended_log_scan(spark, d):
    path = _written_text(_noisy(extended_lines(spark, d)), "extended-log")
    return access_logs.parse_extended(access_logs.read_lines(spark, path))


@query("split_request_s3", _RECORDS + r"""
    SELECT ts, request, body_bytes_sent, split_part(request, ' ', 1) AS method,
      split_part(request, ' ', 2) AS path, nullif(split_part(request, ' ', 3), '') AS http_version
    FROM records""")
def split_request(spark, d):
    path = _written_text(_noisy(extended_lines(spark, d)), "extended-log")
    records = access_logs.parse_extended(access_logs.read_lines(spark, path))
    return access_logs.split_request(records).select(
        "ts", "request", "body_bytes_sent", "method", "path", "http_version")


_CSV = """SELECT ip, date_trunc('second', ts) AS ts, path AS url, file_id, file_type, status, size,
  referrer, user_agent FROM accesses"""


@query("accesses_csv_scan_s4", _CSV)
def accesses_csv_scan(spark, d):
    path = new_path(spark, "accesses-csv")
    access_logs.write_accesses_csv(accesses(spark, d).withColumn("url", c("path")), path)
    return access_logs.read_accesses_csv(spark, path)


@query("accesses_by_day_sink_s5", """
    SELECT CAST(ts AS DATE) AS day, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes_sent
    FROM accesses GROUP BY ALL""")
def accesses_by_day_sink(spark, d):
    path = new_path(spark, "accesses")
    access_logs.write_accesses(accesses(spark, d), path)
    return (spark.read.parquet(path).groupBy("day")
            .agg(F.count("*").alias("requests"), F.sum("size").alias("bytes_sent")))


def written_indexes(spark, entries, by):
    """Indented index files, some for each value of ``by``, as the edges write them."""
    base = new_path(spark, "indexes")
    fields = F.concat_ws(",\n", *[F.concat(F.lit(f'    "{n}": '), F.col(n)) for n in (
        "last_access", "size", "type", "access_count")])
    entry = F.concat(F.lit('  "'), "file_id", F.lit('": {\n'), fields, F.lit("\n  }"))
    files = (entries.groupBy(c(by).alias("name"), F.pmod(F.xxhash64("file_id"), F.lit(16)).alias("part"))
             .agg(F.concat(F.lit("{\n"), F.array_join(F.collect_list(entry), ",\n"), F.lit("\n}")).alias("value")))
    files.write.partitionBy("name", "part").text(base)
    return f"{base}/name=*/part=*"


def index_fields(snap):
    """The fields of an entry as JSON texts."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    return snap.select("region", "file_id", quoted(F.date_format("last_access", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
                       .alias("last_access"), c("size").cast("string").alias("size"), quoted(c("type")).alias("type"),
                       c("access_count").cast("string").alias("access_count"))


_INDEX = """strftime(last_access, '%Y-%m-%dT%H:%M:%S.%f') AS last_access, size, type, access_count,
  CAST(NULL AS VARCHAR) AS creation_time"""


@query("cache_index_scan_s6", f"SELECT region || '/' || file_id AS file_id, {_INDEX} FROM snapshot")
def cache_index_scan(spark, d):
    snap = index_fields(snapshot(spark, d)).withColumn("file_id", F.concat_ws("/", "region", "file_id"))
    return cache_indexes.read_index(spark, written_indexes(spark, snap, "region"))


@query("regional_index_scan_s7", f"SELECT region, file_id, {_INDEX} FROM snapshot")
def regional_index_scan(spark, d):
    named = index_fields(snapshot(spark, d)).withColumn("name", F.concat(F.lit("cache_index_"), "region", F.lit(".json")))
    return cache_indexes.read_regional_indexes(spark, written_indexes(spark, named, "name"))


@query("cache_index_sink_s8", f"SELECT region, file_id, {_INDEX} FROM snapshot")
def cache_index_sink(spark, d):
    path = new_path(spark, "index-lines")
    entries = snapshot(spark, d).withColumn(
        "last_access", F.date_format("last_access", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    cache_indexes.write_index_lines(
        entries.select("region", "file_id", "last_access", "size", "type", "access_count"), path)
    return cache_indexes.read_index_lines(spark, path)


@query("cache_folder_inventory_s9", """SELECT cdn_region, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes
    FROM extended_lines GROUP BY ALL""")
def cache_folder_inventory(spark, d):
    """Files of a folder written from the accesses, one sub-folder per region."""
    path = new_path(spark, "cache-folder")
    extended_lines(spark, d).select("value", "cdn_region").write.partitionBy("cdn_region").text(path)
    files = cache_indexes.read_cache_folder(spark, path).filter(c("name").endswith(".txt"))
    return (files.groupBy(F.regexp_extract("path", "cdn_region=([^/]+)/", 1).alias("cdn_region"))
            .agg(F.sum("size").alias("bytes")))


@query("probe_csv_scan_s10", """
    SELECT date_trunc('second', ts) AS ts, status_code, response_time, size_bytes, url FROM probes""")
def probe_csv_scan(spark, d):
    rows = probes(spark, d).select(F.concat_ws(
        ",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "status_code",
        F.format_string("%.3f", "response_time"), "size_bytes", "url").alias("value"))
    # the header and a line per day, as the prober writes them
    days = probes(spark, d).select(F.explode(F.array(
        F.concat(F.lit("Day "), F.dayofmonth("ts"), F.lit(": started")),
        F.lit(",".join(probe_logs.CSV_COLUMNS)))).alias("value")).distinct()
    return probe_logs.read_probe_csv(spark, _written_text(rows.unionByName(days), "probes"))


@query("probe_text_scan_s11", """
    SELECT try_cast(status_code AS INTEGER) AS status, response_time AS time_total, url FROM probes""")
def probe_text_scan(spark, d):
    rows = probes(spark, d).select(F.concat_ws(
        " ", "status_code", F.format_string("%.3f", "response_time"), "url").alias("value"))
    return probe_logs.read_probe_text(spark, _written_text(rows, "probe-text"))


@query("content_table_scan_s14", "SELECT * FROM content")
def content_table_scan(spark, d):
    path = new_path(spark, "content")
    content(spark, d).write.parquet(path)
    return catalogue.read_content(spark, path)


_RANGES = """WITH ranges AS (SELECT "group", min(id % 100) AS a, max(id % 100) AS b FROM content
  WHERE content_type = 'image' AND "group" <> '' GROUP BY ALL),
numbers AS (SELECT "group", unnest(generate_series(a, b)) AS n FROM ranges)"""


def _image_ranges(spark, d):
    images = content(spark, d).filter((c("content_type") == "image") & (c("group") != ""))
    return images.groupBy("group").agg(
        F.min(c("id") % 100).alias("start"), F.max(c("id") % 100).alias("end")
    ).withColumn("template", F.lit(f"{ORIGIN}/static/images/image_%d.jpg"))


@query("group_range_urls_s15", _RANGES + f"""
    SELECT "group", CAST(n AS INTEGER) AS n, '{CDN}/static/images/image_' || n || '.jpg' AS url FROM numbers""")
def group_range_urls(spark, d):
    return catalogue.urls_of_ranges(_image_ranges(spark, d), ORIGIN, CDN)


@query("items_per_group_a30", """SELECT "group", count(*) AS items, array_to_string(list_transform(
    string_split("group", '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title
    FROM content GROUP BY ALL""")
def items_per_group(spark, d):
    return contents.items_per_group(content(spark, d))


# --- filters ---------------------------------------------------------------------

@query("media_only_f1", """SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '([^.]*)$', 1))
    IN ('jpg', 'jpeg', 'png', 'gif', 'mp4', 'webm', 'mkv')
    UNION ALL SELECT event_id, path FROM accesses""")
def media_only(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url").unionByName(
        accesses(spark, d).select(c("event_id").alias("page_id"), c("path").alias("url")))
    return cleaning.media_only(urls)


@query("named_objects_f2", """SELECT event_id, file_id FROM (SELECT event_id, CASE event_id % 9
    WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE file_id END AS file_id FROM accesses)
    WHERE file_id IS NOT NULL AND file_id NOT IN ('nan', '')""")
def named_objects(spark, d):
    n = c("event_id") % 9
    holes = accesses(spark, d).select("event_id", F.when(n == 0, None).when(n == 1, "nan")
                                      .when(n == 2, "").otherwise(c("file_id")).alias("file_id"))
    return cleaning.named_objects(holes)


@query("ok_statuses_f3", "SELECT event_id, status FROM accesses WHERE status IN (200, 304)")
def ok_statuses(spark, d):
    return cleaning.ok_only(accesses(spark, d)).select("event_id", "status")


@query("without_bots_f4", """SELECT event_id, user_agent FROM accesses
    WHERE NOT lower(user_agent) LIKE '%bot%'""")
def without_bots(spark, d):
    return cleaning.without_bots(accesses(spark, d)).select("event_id", "user_agent")


@query("frequent_object_rows_f5_j2", """
    SELECT event_id, o AS file_id FROM (
      SELECT *, count(*) OVER (PARTITION BY o) AS n FROM (
        SELECT event_id, 'u' || user_id || '_' || k AS o FROM accesses)) WHERE n >= 3""")
def frequent_object_rows(spark, d):
    wide = accesses(spark, d).select("event_id", F.concat(
        F.lit("u"), "user_id", F.lit("_"), "k").alias("file_id"))
    return cleaning.of_frequent_objects(wide, "event_id", 3)


@query("clean_accesses", """SELECT event_id, file_id, file_type AS type, CAST(size AS DOUBLE) AS size
    FROM clean""")
def clean_accesses(spark, d):
    return cleaning.clean_accesses(accesses(spark, d), "event_id").select(
        "event_id", "file_id", "type", "size")


@query("static_get_lines_f6", "SELECT event_id, path, file_type AS type FROM accesses")
def static_get_lines(spark, d):
    return cleaning.static_get_lines(plain_lines(spark, d).select("event_id", "value")).select(
        "event_id", "path", "type")


@query("valid_entries_f7", """
    SELECT region, file_id, CAST(last_access AS TIMESTAMP) AS last_access, size FROM snapshot
    WHERE access_count % 5 NOT IN (0, 1, 2)""")
def valid_entries(spark, d):
    n = c("access_count") % 5
    broken = snapshot(spark, d).select(
        "region", "file_id", F.when(n == 0, None).when(n == 1, "yesterday")
        .otherwise(c("last_access").cast("string")).alias("last_access"),
        F.when(n == 2, -c("size")).otherwise(c("size")).alias("size"))
    return cleaning.valid_entries(broken)


@query("successful_probes_f8", "SELECT event_id, status_code FROM good_probes")
def successful_probes(spark, d):
    return cleaning.successful(probes(spark, d)).select("event_id", "status_code")


@query("accept_or_retry_f9", """SELECT event_id, status_code FROM probes
    WHERE status_code IN ('200', '206', '304', '404')""")
def accept_or_retry(spark, d):
    return cleaning.accept_or_retry(probes(spark, d)).select("event_id", "status_code")


@query("failed_or_retried_f10", """SELECT event_id, status_code FROM probes
    WHERE status_code IN ('FAILED', 'RETRY_1')""")
def failed_or_retried(spark, d):
    return cleaning.failed_or_retried(probes(spark, d)).select("event_id", "status_code")


@query("allowed_uploads_f11", """SELECT id, filename FROM content
    WHERE lower(regexp_extract(filename, '\\.([^.]*)$', 1)) IN ('jpg', 'png', 'mp4', 'mov')""")
def allowed_uploads(spark, d):
    return content(spark, d).filter(paths.allowed_upload(c("filename"))).select("id", "filename")


@query("content_of_group_f12", """SELECT id, filename, "group" FROM content
    WHERE content_type = 'image' AND "group" = 'popular'""")
def content_of_group(spark, d):
    return contents.of_group(content(spark, d), "image", "popular").select(
        "id", "filename", "group")


@query("content_violations_f13", """SELECT * FROM (
    SELECT id, content_type NOT IN ('image', 'video') AS bad_type, "group" = '' AS no_group,
      filename = '' AS no_filename, NOT coalesce(regexp_matches(filename, '\\.(jpg|png|mp4|mov)$'), false)
      AS bad_extension FROM content) WHERE bad_type OR no_group OR no_filename OR bad_extension""")
def content_violations(spark, d):
    return cleaning.content_violations(content(spark, d)).select(
        "id", "bad_type", "no_group", "no_filename", "bad_extension")


@query("unknown_groups_f14", """SELECT id, "group", "group" IN (SELECT DISTINCT "group" FROM content
    WHERE content_type = 'image' AND "group" <> '') AS known FROM content""")
def unknown_groups(spark, d):
    rows = content(spark, d).select("id", "group")
    names = (contents.of_group(content(spark, d), "image").filter(c("group") != "")
             .select("group").distinct())
    return (cleaning.known(rows, names, "group").withColumn("known", F.lit(True))
            .unionByName(cleaning.unknown(rows, names, "group").withColumn("known", F.lit(False))))


# --- joins -------------------------------------------------------------------------

@query("types_by_cache_key_j1", """
    SELECT region, file_id, CASE WHEN access_count % 7 = 0 THEN 'other' ELSE type END AS type
    FROM snapshot""")
def types_by_cache_key(spark, d):
    """Some entries were cached under a versioned URL, which the log does not hold."""
    types = snapshots.types_by_hash(cleaning.static_get_lines(plain_lines(spark, d).select("value")))
    url = F.when(c("access_count") % 7 == 0, F.concat("path", F.lit("?v=1"))).otherwise(c("path"))
    files = snapshot(spark, d).select(
        "region", "file_id", responses.cached_path_of_hash(responses.cache_hash(url)).alias("cached"))
    hashed = files.withColumn("hash", responses.hash_of_cached_path(c("cached")))
    return snapshots.resolve_types(hashed, types).select("region", "file_id", "type")


@query("types_by_hash_a28", """SELECT md5('https://media_origin/media-bucket' || path) AS hash,
    max(file_type) AS type FROM accesses GROUP BY path""")
def types_by_hash(spark, d):
    lines = cleaning.static_get_lines(plain_lines(spark, d).select("value"))
    return snapshots.types_by_hash(lines)


@query("upsert_content_j10", """
    SELECT * FROM content WHERE id % 10 NOT IN (0, 1)
    UNION ALL SELECT id, filename, url || '?v=' || (epoch_us(uploaded_at) // 1000000), content_type,
      'general', uploaded_at FROM content WHERE id % 10 = 0
    UNION ALL SELECT CAST(id + 1000000 AS INTEGER), filename, url, content_type, "group", uploaded_at
      FROM content WHERE id % 10 = 2""")
def upsert_content(spark, d):
    base = content(spark, d)
    n = c("id") % 10
    edited = contents.versioned(base.filter(n == 0), c("uploaded_at")).withColumn(
        "group", F.lit("general"))
    added = base.filter(n == 2).withColumn("id", (c("id") + 1000000).cast("int"))
    changes = (edited.unionByName(added).withColumn("deleted", F.lit(False))
               .unionByName(base.filter(n == 1).withColumn("deleted", F.lit(True))))
    return contents.apply_changes(base, changes)


@query("newest_uploads_k10", 'SELECT id, filename, uploaded_at FROM content WHERE content_type = \'video\'')
def newest_uploads(spark, d):
    return contents.newest_first(contents.of_group(content(spark, d), "video")).select(
        "id", "filename", "uploaded_at")


@query("image_and_video_pool_u1", """SELECT path, popularity FROM (
    SELECT '/static/images/image_' || (p_partkey % 100) || '.jpg' AS path, p_partkey % 10 + 1 AS popularity
    FROM part UNION ALL SELECT '/static/videos/video_' || (p_partkey % 100) || '.mp4', p_partkey % 10 + 1
    FROM part)""")
def image_and_video_pool(spark, d):
    part = table(spark, d, "part").select((c("p_partkey") % 100).alias("n"),
                                          (c("p_partkey") % 10 + 1).alias("popularity"))
    def pool(kind, ext):
        return part.select(F.format_string(f"/static/{kind}s/{kind}_%d.{ext}", "n").alias("path"),
                           "popularity")
    return pool("image", "jpg").unionByName(pool("video", "mp4"))


@query("client_mix", """SELECT cdn_region, CASE
      WHEN regexp_matches(lower(user_agent), 'mobile|android|iphone') THEN 'mobile'
      WHEN regexp_matches(lower(user_agent), 'chrome|firefox|safari|edge') THEN 'desktop'
      ELSE 'other' END AS client_type, count(*) AS requests FROM accesses GROUP BY ALL""")
def client_mix(spark, d):
    return (accesses(spark, d)
            .groupBy("cdn_region", clients.client_class(c("user_agent")).alias("client_type"))
            .agg(F.count("*").alias("requests")))
