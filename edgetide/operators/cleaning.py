"""Filters over accesses, snapshots and catalogue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.functions import clients, paths
from edgetide.functions import fixed_values as fixed
from edgetide.operators.ordered import group_total
from edgetide.staging import stage


def media_only(accesses: DataFrame, path: str = "url") -> DataFrame:
    return accesses.filter(paths.media_type(F.col(path)) != "other")


def computed_once(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is worked out once a row, however often later filters name it.

    A filter on a computed column moves below the projection and takes a copy of the whole
    expression for each mention; it does not move below a generator.
    """
    return rows.withColumn(column, F.explode(F.array(column)))


def named_objects(accesses: DataFrame) -> DataFrame:
    """Drop NULL, ``nan`` and empty object ids."""
    return accesses.filter(F.col("file_id").isNotNull() & ~F.col("file_id").isin("nan", ""))


def ok_only(accesses: DataFrame, statuses=None) -> DataFrame:
    return accesses.filter(F.col("status").isin(list(statuses or fixed.OK_STATUSES)))


def without_bots(accesses: DataFrame) -> DataFrame:
    return accesses.filter(~clients.is_bot(F.col("user_agent")))


def numeric_size(size: Column) -> Column:
    """The size as a number, 0 where it is missing or not one."""
    return F.coalesce(size.try_cast("double"), F.lit(0.0))


def with_class(accesses: DataFrame, strict: bool = False, labelled: bool | None = None
               ) -> DataFrame:
    """Add ``type``: from the label column, or from the id where no label exists at all.

    Pass ``labelled`` when that is known; otherwise each partition is read up to its
    first label.
    """
    by_id = paths.content_class(F.col("file_id"))
    if labelled is False or "file_type" not in accesses.columns:
        return accesses.withColumn("type", by_id)
    by_label = paths.class_of_label(F.col("file_type"), strict)
    if labelled:
        return accesses.withColumn("type", by_label)
    labels = (accesses.filter(F.col("file_type").isNotNull()).limit(1)
              .select(F.count("file_type")).scalar())
    return accesses.withColumn("type", F.when(labels == 0, by_id).otherwise(by_label))


def frequent_objects(accesses: DataFrame, at_least: int = fixed.MIN_OBJECT_ACCESSES) -> DataFrame:
    counts = accesses.groupBy("file_id").agg(F.count("*").alias("accesses"))
    return counts.filter(F.col("accesses") >= at_least)


def of_frequent_objects(accesses: DataFrame, row_key: str,
                        at_least: int = fixed.MIN_OBJECT_ACCESSES) -> DataFrame:
    """Rows whose object has enough accesses; hot objects are spread by ``row_key``."""
    counted = group_total(accesses, "file_id", row_key, "_accesses")
    return counted.filter(F.col("_accesses") >= at_least).drop("_accesses")


def usable(accesses: DataFrame, statuses=None) -> DataFrame:
    """Named objects, good statuses, no bots: the filters that need one row only.

    The id is mostly parsed from the log line, so it is looked at last.
    """
    return named_objects(computed_once(without_bots(ok_only(accesses, statuses)), "file_id"))


def typed(accesses: DataFrame, strict_class: bool = False, labelled: bool | None = None
          ) -> DataFrame:
    """Add the content class, the numeric size and its logarithm, and the client class."""
    size = numeric_size(F.col("size"))
    return with_class(accesses, strict_class, labelled).withColumns({
        "size": size, "log_file_size": F.log1p(size),
        "client_type": clients.client_class(F.col("user_agent")),
    })


def clean_accesses(accesses: DataFrame, row_key: str, strict_class: bool = False,
                   at_least: int = fixed.MIN_OBJECT_ACCESSES, statuses=None,
                   labelled: bool | None = None) -> DataFrame:
    """Usable accesses with their classes, of objects that have enough of them."""
    return of_frequent_objects(typed(usable(accesses, statuses), strict_class, labelled),
                               row_key, at_least)


def static_get_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """GET lines below /static/ with a media extension, as (path, type)."""
    request = F.split(F.get(F.split(F.col(line), '"'), F.lit(1)), r"\s+")
    path = F.get(request, F.lit(1))
    return (lines
            .filter(F.col(line).contains("GET") & F.col(line).contains("/static/"))
            .withColumns({"path": path, "type": paths.media_type(path)})
            .filter(F.col("type") != "other"))


def _is_valid() -> Column:
    return F.coalesce(F.col("last_access").try_cast("timestamp_ntz").isNotNull() & (F.col("size") > 0), F.lit(False))


def valid_entries(entries: DataFrame) -> DataFrame:
    """Snapshot rows with a parseable last access and a positive size."""
    return entries.filter(_is_valid()).withColumn("last_access", F.col("last_access").try_cast("timestamp_ntz"))


def broken_entries(entries: DataFrame) -> DataFrame:
    """The other rows, as they are."""
    return entries.filter(~_is_valid())


def accept_or_retry(probes: DataFrame) -> DataFrame:
    """Probes that need no retry: 2xx, 3xx or 404."""
    return probes.filter(F.col("status_code").rlike("^[23][0-9][0-9]$")
                         | (F.col("status_code") == "404"))


def successful(probes: DataFrame) -> DataFrame:
    """2xx and 3xx, tested on the status column."""
    return probes.filter(F.col("status_code").rlike("^[23][0-9][0-9]$"))


def failed_or_retried(probes: DataFrame) -> DataFrame:
    return probes.filter((F.col("status_code") == "FAILED")
                         | F.col("status_code").startswith("RETRY_"))


def content_violations(content: DataFrame) -> DataFrame:
    """Records that break a rule, with one flag per rule."""
    rules = {
        "bad_type": F.coalesce(~F.col("content_type").isin("image", "video"), F.lit(True)),
        "no_group": F.coalesce(F.col("group") == "", F.lit(True)),
        "no_filename": F.coalesce(F.col("filename") == "", F.lit(True)),
        "bad_extension": F.coalesce(~paths.allowed_upload(F.col("filename")), F.lit(True)),
    }
    broken = F.lit(False)
    for name in rules:
        broken = broken | F.col(name)
    return content.withColumns(rules).filter(broken)


def known(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows whose name is listed. Staged names are broadcast only if they are small."""
    return rows.join(stage(names.select(column).distinct(), "names"), column, "left_semi")


def unknown(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return rows.join(stage(names.select(column).distinct(), "names"), column, "left_anti")
