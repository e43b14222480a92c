"""Content catalogue scans and the group-range source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import paths

SCHEMA = ("id INT, filename STRING, url STRING, content_type STRING, `group` STRING, "
          "uploaded_at TIMESTAMP_NTZ")


def read_content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_content_jdbc(spark: SparkSession, url: str, table: str, partitions: int,
                      lowest_id: int, highest_id: int, **options: str) -> DataFrame:
    """The catalogue in a relational database, read in parallel by id range."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, **options)
            .option("partitionColumn", "id").option("lowerBound", lowest_id)
            .option("upperBound", highest_id).option("numPartitions", partitions).load())


def urls_of_ranges(ranges: DataFrame, origin: str, cdn: str, active=True) -> DataFrame:
    """One URL per number in each inclusive range (group, template, start, end).

    ``template`` has one ``%d`` for the number.
    """
    return (ranges
            .select("group", "template", F.explode(F.sequence("start", "end")).alias("n"))
            .select("group", "n",
                    paths.cdn_url(F.format_string("%s%d%s", F.substring_index("template", "%d", 1), "n",
                                                  F.substring_index("template", "%d", -1)),
                                  origin, cdn, active).alias("url")))
