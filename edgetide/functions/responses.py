"""Expressions over responses, regions and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.functions.paths import one_of


def cache_policy(kind: Column) -> Column:
    """Cache-Control text for static, media, page and api responses; NULL for others."""
    return one_of(kind, fixed.CACHE_POLICY)


def policy_max_age(kind: Column) -> Column:
    return one_of(kind, fixed.POLICY_MAX_AGE)


def weak_etag(body: Column) -> Column:
    return F.concat(F.lit('W/"'), F.substring(F.md5(body.cast("binary")), 1, 16), F.lit('"'))


def region_flag(label: Column) -> Column:
    answer = None
    for part, flag in fixed.REGION_FLAGS:
        answer = F.when(label.contains(part), F.lit(flag)) if answer is None \
            else answer.when(label.contains(part), F.lit(flag))
    return answer.otherwise(F.lit(fixed.OTHER_REGION_FLAG))


def cache_key(path: Column, scheme: str, host: str, prefix: str) -> Column:
    """Text the edge hashes to name a cached file."""
    return F.concat(F.lit(f"{scheme}://{host}{prefix}"), path)


def cache_hash(path: Column, scheme: str = "https", host: str = "media_origin",
               prefix: str = "/media-bucket") -> Column:
    return F.md5(cache_key(path, scheme, host, prefix).cast("binary"))


def hash_of_cached_path(cached_path: Column) -> Column:
    """Last 32 characters of the file name without its extension."""
    name = F.substring_index(cached_path, "/", -1)
    stem = F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")
    return F.right(stem, F.lit(32))


def cached_path_of_hash(digest: Column) -> Column:
    """Two directory levels of two characters each, taken from the end of the hash."""
    return F.concat_ws("/", F.substring(digest, 31, 2), F.substring(digest, 29, 2), digest)


def load_multiplier(hour: Column) -> Column:
    answer = None
    for first, last, factor in fixed.LOAD_BANDS:
        condition = hour.between(first, last)
        answer = F.when(condition, F.lit(factor)) if answer is None \
            else answer.when(condition, F.lit(factor))
    return answer.otherwise(F.lit(1.0))


def plain_log_line(ip: Column, ts: Column, method: Column, path: Column, status: Column,
                   size: Column, referrer: Column, user_agent: Column) -> Column:
    """An access as one combined-format log line, time in UTC."""
    return F.format_string('%s - - [%s +0000] "%s %s HTTP/1.1" %d %d "%s" "%s"', ip,
                           F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), method, path, status,
                           size, referrer, user_agent)


def extended_log_line(plain_line: Column, cache_status: Column, cdn_region: Column,
                      lat: Column, request_time: Column) -> Column:
    """The plain line with the cache, region and latency fields appended."""
    return F.concat(plain_line, F.lit(' "-" cache_status='), cache_status,
                    F.lit(" cdn_region="), cdn_region, F.lit(" lat="),
                    F.when(lat.isNull(), F.lit("-")).otherwise(F.format_string("%.3f", lat)),
                    F.lit(" rt="), F.format_string("%.3f", request_time))
