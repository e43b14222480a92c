"""Expressions over paths, URLs and content classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed


def one_of(value: Column, table: dict, default: Column | None = None) -> Column:
    """Look ``value`` up in a small literal table, as a foldable CASE."""
    by_result: dict = {}
    for key, result in table.items():
        by_result.setdefault(result, []).append(key)
    branches = None
    for result, keys in by_result.items():
        condition = value.isin(keys)
        branches = F.when(condition, F.lit(result)) if branches is None \
            else branches.when(condition, F.lit(result))
    return branches if default is None else branches.otherwise(default)


def extension(path: Column) -> Column:
    """Text after the last dot in lower case; the whole text when there is no dot."""
    return F.lower(F.substring_index(path, ".", -1))


def object_id(path: Column) -> Column:
    """Last path segment up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def media_type(path: Column, strip_query: bool = False) -> Column:
    """image / video / other by extension.

    A query string hides the extension (``.jpg?v=1`` is ``other``) unless
    ``strip_query`` is set.
    """
    if strip_query:
        path = F.substring_index(F.substring_index(path, "#", 1), "?", 1)
    return one_of(extension(path), fixed.MEDIA_TYPE_BY_EXTENSION, F.lit("other"))


def _class_by_extension() -> dict:
    return {e: name for name, exts in fixed.EXTENSIONS_BY_CLASS.items() for e in exts}


def content_class(identifier: Column) -> Column:
    """Content class of an object id or URL; ``unknown`` when it has no dot.

    Looked up in a map: a CASE holds a copy of the path's expression for every class, and code
    of that length is not compiled.
    """
    path = F.when(identifier.startswith("http"),
                  F.coalesce(F.try_parse_url(identifier, F.lit("PATH")), F.lit(""))
                  ).otherwise(identifier)
    classes = F.create_map(*[F.lit(text) for pair in _class_by_extension().items() for text in pair])
    return (F.when(identifier.isNull() | ~path.contains("."), F.lit("unknown"))
            .otherwise(F.coalesce(F.try_element_at(classes, extension(path)), F.lit("other"))))


def class_of_label(label: Column, strict: bool = False) -> Column:
    """Content class of an extension label.

    ``strict`` knows extensions and a few class names only, so the labels ``image``
    and ``video`` come out as ``other``; by default every class name is kept.
    """
    table = _class_by_extension()
    names = fixed.CLASS_NAMES_ACCEPTED_AS_LABELS if strict else \
        [n for n in fixed.CLASS_ORDINAL if n not in ("other", "unknown")]
    table.update({name: name for name in names})
    return (F.when(label.isNull(), F.lit("unknown"))
            .otherwise(one_of(F.lower(label), table, F.lit("other"))))


def class_ordinal(name: Column) -> Column:
    return one_of(name, fixed.CLASS_ORDINAL, F.lit(fixed.MISSING_CLASS_ORDINAL))


def keep_known_class(name: Column, allowed=None) -> Column:
    """Names outside ``allowed`` (default: every class) become ``other``; so do NULLs."""
    allowed = list(fixed.CLASS_ORDINAL) if allowed is None else list(allowed)
    return F.when(name.isin(allowed), name).otherwise(F.lit("other"))


def underscores(identifier: Column) -> Column:
    """Number of underscores, an old stand-in for the access count."""
    return F.length(identifier) - F.length(F.replace(identifier, F.lit("_"), F.lit("")))


def url_category(url: Column) -> Column:
    """First two path segments after the host; other text passes through."""
    return F.regexp_replace(url, fixed.CATEGORY_OF_URL, "$1")


def route_class(path: Column) -> Column:
    """How an edge would route a path: a regex route wins over a prefix route."""
    return (F.when(path.rlike("(?i)" + fixed.MEDIA_ROUTE), F.lit("static_media"))
            .when(path.rlike(fixed.HIDDEN_ROUTE), F.lit("hidden"))
            .when(path.rlike("(?i)" + fixed.ENV_ROUTE), F.lit("env_file"))
            .when(path.startswith("/health"), F.lit("health"))
            .otherwise(F.lit("page")))


def group_title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))


def cdn_url(origin_url: Column, origin: str, cdn: str, active: Column | bool = True) -> Column:
    """Origin URL rewritten to the CDN while the CDN is up."""
    active = F.lit(active) if isinstance(active, bool) else active
    return F.when(active, F.replace(origin_url, F.lit(origin), F.lit(cdn))).otherwise(origin_url)


def versioned_url(url: Column, changed_at: Column) -> Column:
    """URL with ``?v=<epoch seconds>`` so that caches fetch it again."""
    return F.concat(url, F.lit("?v="), epoch_seconds(changed_at).cast("string"))


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds from one zone-free timestamp to another, exact to the microsecond.

    The difference is an interval, so the session's zone plays no part.
    """
    return (later - earlier).cast("interval second").cast("decimal(18,6)")


def _since_epoch(ts: Column) -> Column:
    return seconds_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-free UTC timestamp."""
    return (_since_epoch(ts) * 1000000).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    return F.floor(_since_epoch(ts)).cast("bigint")


def epoch_millis(ts: Column) -> Column:
    return F.floor(_since_epoch(ts) * 1000).cast("bigint")


def at_millis(millis: Column) -> Column:
    """The zone-free timestamp of ``epoch_millis``."""
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, (millis.cast("decimal(18,3)") / 1000).cast("decimal(18,6)"))


def allowed_upload(filename: Column) -> Column:
    return filename.contains(".") & extension(filename).isin(fixed.UPLOAD_EXTENSIONS)
