"""Content catalogue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.functions import paths


def of_group(content: DataFrame, content_type: str, group: str | None = None) -> DataFrame:
    """Records of one type (and group); plain comparisons reach the scan."""
    kept = content.filter(F.col("content_type") == content_type)
    return kept if group is None else kept.filter(F.col("group") == group)


def newest_first(content: DataFrame) -> DataFrame:
    return content.orderBy(F.desc("uploaded_at"), "id")


def items_per_group(content: DataFrame) -> DataFrame:
    return (content.groupBy("group").agg(F.count("*").alias("items"))
            .withColumn("title", paths.group_title(F.col("group"))))


def apply_changes(content: DataFrame, changes: DataFrame, sequence: str | None = None) -> DataFrame:
    """Upsert and delete by id.

    ``changes`` has the catalogue columns and ``deleted``.  With ``sequence``, a column that
    orders the changes of an id, the newest of each counts; without it there is one row per id.
    Unchanged records pass through an anti join on the unique id.
    """
    if sequence is not None:
        changes = (changes.groupBy("id").agg(F.max_by(F.struct(*changes.columns), sequence).alias("c"))
                   .select("c.*"))
    kept = content.join(changes.select("id"), "id", "left_anti")
    return kept.unionByName(changes.filter(~F.col("deleted")).drop("deleted")
                            .select(*content.columns))


def versioned(content: DataFrame, changed_at) -> DataFrame:
    return content.withColumn("url", paths.versioned_url(F.col("url"), changed_at))
