"""Log-shaped views over the given tables, in Spark and in SQL.

The tables hold no web logs, so accesses are mapped from ``events`` row by row, the
catalogue from ``part``, and predictions are fixed expressions over the snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import responses
from edgetide.operators import snapshot as snapshots

AS_OF = "2024-02-01 00:00:00"
LIMIT_MB = 40
ORIGIN = "https://origin.example/media-bucket"
CDN = "https://cdn.example"
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/136.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Version/14.0.3 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:89.0) Gecko/20100101 Firefox/89.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Mobile/15E148",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "opera-tv",
]
REGIONS = ["sea", "us-east", "eu-west"]
EXTENSIONS = ["jpg", "png", "mp4", "mov", "exe"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One access per event."""
    kind = F.col("event_type")
    return accesses_from(table(spark, sf_dir, "events"), kind)


def accesses_from(events: DataFrame, kind: Column) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    image = F.col("k") < 50
    name = F.when(image, F.concat(F.lit("image_"), F.col("k"))).otherwise(
        F.concat(F.lit("video_"), F.col("k") - 50))
    path = F.when(image, F.concat(F.lit("/static/images/"), name, F.lit(".jpg"))).otherwise(
        F.concat(F.lit("/static/videos/"), name, F.lit(".mp4")))
    millis = F.round("value", 0).cast("bigint")
    return events.withColumn("k", k).select(
        "event_id", "ts", "user_id", "k", name.alias("file_id"), path.alias("path"),
        F.when(image, "image").otherwise("video").alias("file_type"),
        F.concat(F.lit("192.0.2."), F.col("user_id") % 254 + 1).alias("ip"),
        F.lit("GET").alias("method"),
        F.when(kind == "signup", 304).when(kind == "purchase", 206).when(kind == "error", 404)
        .otherwise(200).alias("status"),
        F.when(kind == "signup", "EXPIRED").when(kind == "purchase", "MISS")
        .when(kind == "error", "-").otherwise("HIT").alias("cache_status"),
        _pick(REGIONS, F.col("user_id") % 3).alias("cdn_region"),
        (F.round(F.col("value") * 100, 0).cast("bigint") * 100).alias("size"),
        (millis / 1000.0).alias("request_time"),
        F.when(kind.isin("signup", "purchase"), F.floor(millis / 2) / 1000.0).alias("lat"),
        F.when(image, "https://site.example/images/general")
        .otherwise("https://site.example/videos/tutorials").alias("referrer"),
        _pick(AGENTS, F.col("event_id") % 6).alias("user_agent"))


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return accesses(spark, sf_dir).withColumn("value", responses.plain_log_line(
        c("ip"), c("ts"), c("method"), c("path"), c("status"), c("size"), c("referrer"),
        c("user_agent")))


def extended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return plain_lines(spark, sf_dir).withColumn("value", responses.extended_log_line(
        c("value"), c("cache_status"), c("cdn_region"), c("lat"), c("request_time")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses with the column names of a parsed extended line."""
    return accesses(spark, sf_dir).withColumn("body_bytes_sent", F.col("size"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index per region and object, with the path the objects have in this mapping."""
    index = snapshots.index_from_log(accesses(spark, sf_dir))
    folder = F.when(F.col("type") == "image", "/static/images/").otherwise("/static/videos/")
    ext = F.when(F.col("type") == "image", ".jpg").otherwise(".mp4")
    return index.withColumn("path", F.concat(folder, "file_id", ext))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.serving_features(snapshot(spark, sf_dir), AS_OF).withColumns({
        "p": (F.col("access_count") % 10) / 10.0,
        "distance": (F.col("size") / 100.0) % 400,
        "reuse": (F.col("access_count") % 7) / 5.0 - 0.1})


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.col("event_id") % 50
    return accesses(spark, sf_dir).select(
        "event_id", "ts",
        F.when(mark == 0, "FAILED").when(mark == 1, "RETRY_1")
        .otherwise(F.col("status").cast("string")).alias("status_code"),
        F.col("request_time").alias("response_time"), F.col("size").alias("size_bytes"),
        F.concat(F.lit(CDN), "path").alias("url"))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, with a few records that break its rules."""
    id_ = F.col("p_partkey")
    ext = _pick(EXTENSIONS, F.col("p_size") % 5)
    kind = F.when(ext.isin("jpg", "png"), "image").when(ext.isin("mp4", "mov"), "video") \
        .otherwise("other")
    n = id_ % 100
    v = id_ % 66
    group = (F.when(id_ % 37 == 0, "").when(
        kind == "image", F.when(n < 10, "trending").when(n < 30, "popular")
        .when(n < 80, "general").otherwise("rare"))
        .otherwise(F.when(v < 10, "short-clips").when(v < 30, "documentaries")
                   .when(v < 60, "tutorials").otherwise("archived")))
    filename = F.when(id_ % 41 == 0, "").otherwise(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), ext))
    return table(spark, sf_dir, "part").select(
        id_.cast("int").alias("id"), filename.alias("filename"),
        F.concat(F.lit(f"{ORIGIN}/static/"), filename).alias("url"), kind.alias("content_type"),
        group.alias("group"),
        F.timestamp_add("HOUR", id_ % 500, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("uploaded_at"))


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score, prediction) from labels and document lengths."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = (F.col("n_chars") % 1000) / 1000.0
    return table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), score.alias("score"),
        (score >= 0.5).cast("int").alias("prediction"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


VIEWS = f"""
WITH events_k AS (
  SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CAST(round(value) AS BIGINT) AS millis FROM events),
accesses AS (
  SELECT event_id, ts, user_id, k, k < 50 AS is_image,
    CASE WHEN k < 50 THEN 'image_' || k ELSE 'video_' || (k - 50) END AS file_id,
    CASE WHEN k < 50 THEN '/static/images/image_' || k || '.jpg'
         ELSE '/static/videos/video_' || (k - 50) || '.mp4' END AS path,
    CASE WHEN k < 50 THEN 'image' ELSE 'video' END AS file_type,
    '192.0.2.' || (user_id % 254 + 1) AS ip, 'GET' AS method,
    CASE event_type WHEN 'signup' THEN 304 WHEN 'purchase' THEN 206 WHEN 'error' THEN 404
         ELSE 200 END AS status,
    CASE event_type WHEN 'signup' THEN 'EXPIRED' WHEN 'purchase' THEN 'MISS'
         WHEN 'error' THEN '-' ELSE 'HIT' END AS cache_status,
    {_sql_list(REGIONS)}[CAST(user_id % 3 AS INTEGER) + 1] AS cdn_region,
    CAST(round(value * 100) AS BIGINT) * 100 AS size,
    millis / 1000.0 AS request_time,
    CASE WHEN event_type IN ('signup', 'purchase') THEN (millis // 2) / 1000.0 END AS lat,
    CASE WHEN k < 50 THEN 'https://site.example/images/general'
         ELSE 'https://site.example/videos/tutorials' END AS referrer,
    {_sql_list(AGENTS)}[CAST(event_id % 6 AS INTEGER) + 1] AS user_agent
  FROM events_k),
plain_lines AS (
  SELECT *, ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method || ' '
    || path || ' HTTP/1.1" ' || status || ' ' || size || ' "' || referrer || '" "'
    || user_agent || '"' AS value FROM accesses),
extended_lines AS (
  SELECT * REPLACE (value || ' "-" cache_status=' || cache_status || ' cdn_region='
    || cdn_region || ' lat=' || coalesce(printf('%.3f', CAST(lat AS DOUBLE)), '-') || ' rt='
    || printf('%.3f', CAST(request_time AS DOUBLE)) AS value) FROM plain_lines),
snapshot AS (
  SELECT cdn_region AS region, file_id, max(ts) AS last_access, arg_max(size, ts) AS size,
    max(path) AS path, count(*) AS access_count, max(file_type) AS type
  FROM accesses WHERE status IN (200, 304) GROUP BY ALL),
featured AS (
  SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_access)) / 1e6
      AS age_since_last_access,
    (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_access)) / 1e6 / 3600.0 AS age_hours
  FROM snapshot),
predictions AS (
  SELECT *, (access_count % 10) / 10.0 AS p, (size / 100.0) % 400 AS distance,
    (access_count % 7) / 5.0 - 0.1 AS reuse FROM featured),
probes AS (
  SELECT event_id, ts, CASE event_id % 50 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RETRY_1'
      ELSE CAST(status AS VARCHAR) END AS status_code,
    request_time AS response_time, size AS size_bytes, '{CDN}' || path AS url FROM accesses),
good_probes AS (
  SELECT * FROM probes WHERE try_cast(status_code AS INTEGER) BETWEEN 200 AND 399),
part_ext AS (
  SELECT *, {_sql_list(EXTENSIONS)}[p_size % 5 + 1] AS ext FROM part),
part_kind AS (
  SELECT *, CASE WHEN ext IN ('jpg', 'png') THEN 'image' WHEN ext IN ('mp4', 'mov') THEN 'video'
    ELSE 'other' END AS kind,
    CASE WHEN p_partkey % 41 = 0 THEN '' ELSE replace(p_name, ' ', '_') || '.' || ext END
      AS filename FROM part_ext),
content AS (
  SELECT CAST(p_partkey AS INTEGER) AS id, filename, '{ORIGIN}/static/' || filename AS url,
    kind AS content_type,
    CASE WHEN p_partkey % 37 = 0 THEN ''
      WHEN kind = 'image' THEN CASE WHEN p_partkey % 100 < 10 THEN 'trending'
        WHEN p_partkey % 100 < 30 THEN 'popular' WHEN p_partkey % 100 < 80 THEN 'general'
        ELSE 'rare' END
      ELSE CASE WHEN p_partkey % 66 < 10 THEN 'short-clips' WHEN p_partkey % 66 < 30
        THEN 'documentaries' WHEN p_partkey % 66 < 60 THEN 'tutorials' ELSE 'archived' END
      END AS "group",
    TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 500 AS INTEGER)) AS uploaded_at
  FROM part_kind),
labelled_scores AS (
  SELECT doc_id, quality AS label, (n_chars % 1000) / 1000.0 AS score,
    CAST((n_chars % 1000) / 1000.0 >= 0.5 AS INTEGER) AS prediction
  FROM labels JOIN documents USING (doc_id)),
clean AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY file_id) AS n_file FROM accesses
    WHERE status IN (200, 304) AND NOT lower(user_agent) LIKE '%bot%') WHERE n_file >= 2),
trace AS (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos,
    row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id) AS seq,
    lag(ts) OVER (PARTITION BY file_id ORDER BY ts, event_id) AS prev_ts FROM clean)
"""


def with_views(sql: str) -> str:
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + text[15:]
    if text.upper().startswith("WITH "):
        return VIEWS + ", " + text[5:]
    return VIEWS + text
