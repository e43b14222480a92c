"""The traffic report as one table of sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.operators import traffic
from edgetide.operators.cleaning import successful
from edgetide.operators.ordered import exact_median
from edgetide.staging import new_path, stage


def _section(df: DataFrame, title: str, item, value) -> DataFrame:
    return df.select(F.lit(title).alias("section"), item.cast("string").alias("item"),
                     value.cast("double").alias("value"))


def _wide(df: DataFrame, title: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value"))
             for n in df.columns]
    return df.select(F.lit(title).alias("section"), F.explode(F.array(*pairs)).alias("p")).select(
        "section", "p.item", "p.value")


def summarise(probes: DataFrame, ts: str = "ts") -> DataFrame:
    """One pass over the probes: requests and response times per URL, status and hour."""
    time = F.col("response_time")
    return stage(probes.groupBy("url", "status_code", F.hour(ts).alias("hour")).agg(
        F.count("*").alias("n"), F.sum(time).alias("time_sum"), F.count(time).alias("time_n"),
        F.min(time).alias("time_min"), F.max(time).alias("time_max")), "report-summary")


def _times(summary: DataFrame, probes: DataFrame) -> DataFrame:
    times = successful(summary).agg(
        (F.sum("time_sum") / F.sum("time_n")).alias("mean"), F.min("time_min").alias("least"),
        F.max("time_max").alias("greatest"))
    return times.withColumn("median", exact_median(successful(probes), "response_time").scalar())


def traffic_report(probes: DataFrame) -> DataFrame:
    """(section, item, value) for every section of the report.

    The probes are read twice: for the summary all sections share, and for the median.
    """
    c = F.col
    summary = summarise(probes)
    hours = (successful(summary).groupBy("hour").agg(F.sum("n").alias("requests")))
    parts = [
        _wide(traffic.totals(summary, "n"), "statistics"),
        _wide(traffic.success_rate(summary, "n"), "success_rate"),
        _section(traffic.top_urls(summary, 20, "n"), "top_urls", c("url"), c("requests")),
        _section(traffic.category_counts(summary, "n"), "categories", c("category"), c("requests")),
        _section(traffic.kind_counts(summary, "n"), "kinds", c("kind"), c("requests")),
        _wide(_times(summary, probes), "response_times"),
        _section(traffic.rank_frequency(traffic.url_counts(summary, "n"), top=50), "zipf",
                 F.concat_ws(",", "rank", "url"), c("requests")),
        _section(hours, "hourly", c("hour"), c("requests")),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def write_report(probes: DataFrame, path: str) -> None:
    """One folder per section."""
    traffic_report(probes).write.mode("overwrite").partitionBy("section").parquet(path)


def written_report(probes: DataFrame) -> DataFrame:
    path = new_path(probes.sparkSession, "report")
    write_report(probes, path)
    return probes.sparkSession.read.schema("item STRING, value DOUBLE, section STRING").parquet(path)
