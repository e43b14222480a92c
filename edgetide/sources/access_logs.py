"""Access-log scans (plain and extended lines) and the parsed-access CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths

CSV_SCHEMA = ("ip STRING, timestamp STRING, url STRING, file_id STRING, file_type STRING, "
              "status STRING, size STRING, referrer STRING, user_agent STRING")


def utc(ts: Column) -> Column:
    """An instant as a zone-free UTC timestamp, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _fields(lines: DataFrame, line: str, pattern: str, groups: int, marker: str) -> DataFrame:
    """Lines that match ``pattern``, with its groups as the array ``f``.

    One replace puts all groups behind separators; a line that does not match stays in
    one piece and is dropped.  The explode of a one-element array keeps later filters
    from repeating the pattern below it.  Edges escape control characters in their
    logs, so the separator is not part of a field.
    """
    others = [c for c in lines.columns if c != line]
    joined = _SEP.join(f"${i}" for i in range(1, groups + 1))
    fields = F.split(F.regexp_replace(F.col(line), pattern, joined), _SEP)
    return (lines.filter(F.col(line).contains(marker))
            .select(*others, F.explode(F.array(fields)).alias("f"))
            .filter(F.size("f") == groups))


_SEP = "\u0001"


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


def parse_plain(lines: DataFrame, strip_query: bool = False, line: str = "value") -> DataFrame:
    """Plain access-log lines to typed rows.

    Lines that do not match, whose path is not media, or whose time does not parse
    are dropped.  Other columns of ``lines`` are kept.
    """
    others = [c for c in lines.columns if c != line]
    parsed = _fields(lines, line, fixed.PLAIN_LINE + ".*$", 8, " HTTP/")
    path = _f(3)
    instant = F.try_to_timestamp(_f(1), F.lit(fixed.LOG_TIME_FORMAT))
    return (parsed
            .select(*others, _f(0).alias("ip"), utc(instant).alias("ts"), path.alias("url"),
                    paths.object_id(path).alias("file_id"),
                    paths.media_type(path, strip_query).alias("file_type"),
                    _f(4).try_cast("int").alias("status"),
                    _f(5).try_cast("bigint").alias("size"),
                    _f(6).alias("referrer"), _f(7).alias("user_agent"))
            .filter((F.col("file_type") != "other") & F.col("ts").isNotNull()))


def parse_extended(lines: DataFrame, line: str = "value", region_from: Column | None = None,
                   keep_instant: bool = False) -> DataFrame:
    """Extended lines to typed metric records.

    ``-`` in a numeric field becomes NULL.  ``cdn_region`` is what the client sent;
    ``region_from`` (say, from the file name) replaces a ``-``.  Streams set
    ``keep_instant``: a watermark needs a timestamp with zone.
    """
    others = [c for c in lines.columns if c != line]
    parsed = _fields(lines, line, fixed.EXTENDED_LINE, 11, " cache_status=")
    region = _f(8)
    if region_from is not None:
        region = F.when(region == "-", region_from).otherwise(region)
    instant = F.try_to_timestamp(_f(1), F.lit(fixed.LOG_TIME_FORMAT))
    return parsed.select(
        *others, _f(0).alias("remote_addr"),
        (instant if keep_instant else utc(instant)).alias("ts"), _f(2).alias("request"),
        _f(3).try_cast("int").alias("status"), _f(4).try_cast("bigint").alias("body_bytes_sent"),
        _f(5).alias("http_referer"), _f(6).alias("http_user_agent"), _f(7).alias("cache_status"),
        region.alias("cdn_region"), _f(9).try_cast("double").alias("lat"),
        _f(10).try_cast("double").alias("request_time"))


def split_request(records: DataFrame, request: str = "request") -> DataFrame:
    """Add method, path and http_version; the version is NULL when absent."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(F.col(request), fixed.REQUEST_FIELD, i), F.lit(""))
    return records.withColumns({"method": part(1), "path": part(2), "http_version": part(3)})


def read_accesses_csv(spark: SparkSession, path: str) -> DataFrame:
    """Parsed accesses: times and numbers that do not parse become NULL."""
    raw = spark.read.schema(CSV_SCHEMA).csv(path, header=True, escape='"')
    return raw.select(
        "ip", utc(F.col("timestamp").try_cast("timestamp")).alias("ts"), "url", "file_id",
        "file_type", F.col("status").try_cast("int").alias("status"),
        F.col("size").try_cast("bigint").alias("size"), "referrer", "user_agent")


def write_accesses_csv(accesses: DataFrame, path: str) -> None:
    (accesses
     .withColumn("timestamp", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                                       F.lit("+00:00")))
     .select("ip", "timestamp", "url", "file_id", "file_type", "status", "size", "referrer",
             "user_agent")
     .write.mode("overwrite").option("escape", '"').csv(path, header=True))


def write_accesses(accesses: DataFrame, path: str) -> None:
    """Columnar form, one folder per day, for jobs that read a time range."""
    (accesses.withColumn("day", F.to_date("ts"))
     .repartitionByRange("day", "file_id")      # few files a day, days of any size split
     .write.mode("overwrite").partitionBy("day").parquet(path))
