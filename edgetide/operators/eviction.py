"""Eviction plans: score, cut, survivors, metrics.

All regions are planned together.  A plan lists what to evict; nothing is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgetide.functions import fixed_values as fixed
from edgetide.functions import scores
from edgetide.operators.ordered import BLOCK, SLOT, join_same, offsets, order_blocks, with_rank
from edgetide.operators.snapshot import frequency_statistics, over_limit
from edgetide.staging import stage

MB = 1024 * 1024


def lru_scored(snapshot: DataFrame, as_of) -> DataFrame:
    aged = snapshot.withColumns({
        "age_hours": scores.age_seconds(F.col("last_access"), as_of) / 3600.0,
        "access_count": F.coalesce("access_count", F.lit(1))})
    return aged.withColumn("score", scores.lru_score(
        F.col("age_hours"), F.col("access_count"), F.col("size")))


def lfu_scored(with_frequency: DataFrame) -> DataFrame:
    """Scores rows that already have frequency, age_hours and access_count."""
    return with_frequency.withColumn("score", scores.lfu_score(
        F.col("frequency"), F.col("age_hours"), F.col("access_count"), F.col("size")))


def lrb_scored(features: DataFrame, weights: dict | None = None) -> DataFrame:
    """Learned score from p, distance and reuse.

    The fallback counts where a region's scores are all 0, and for rows no model answered.
    """
    raw = stage(features.withColumn("score", scores.lrb_score(
        F.col("p"), F.col("distance"), F.col("reuse"), weights)), "raw-scores")
    zero = F.broadcast(raw.groupBy("region").agg(        # one row per region
        (F.coalesce(F.max(F.abs("score")), F.lit(0.0)) == 0).alias("_all_zero")))
    plain = scores.fallback_score(F.col("age_since_last_access"), F.col("access_count"))
    return (join_same(raw, zero, ["region"])
            .withColumn("score", F.when(F.col("_all_zero"), plain).otherwise(F.coalesce("score", plain)))
            .drop("_all_zero"))


def belady_scored(features: DataFrame, strategy: str = "lrb", by=("region",)) -> DataFrame:
    """Relaxed-Belady score; distances are divided by the largest one of the region."""
    cleaned = stage(features.withColumns({
        "distance": scores.clean_distance(F.col("distance")),
        "reuse": scores.clean_probability(F.col("reuse"))}), "cleaned")
    largest = cleaned.groupBy(*by).agg(F.max("distance").alias("_max"))
    return (join_same(cleaned, largest, list(by))
            .withColumn("score", scores.belady_score(
                strategy, F.col("p"), F.col("distance"), F.col("reuse"), F.col("_max")))
            .drop("_max"))


def belady_fallback_scored(features: DataFrame, by=("region",)) -> DataFrame:
    features = stage(features, "aged")
    oldest = features.groupBy(*by).agg(F.max("age_since_last_access").alias("_max"))
    return (join_same(features, oldest, list(by))
            .withColumn("score", scores.belady_fallback(
                F.col("age_since_last_access"), F.col("access_count"), F.col("_max")))
            .drop("_max"))


def eviction_cut(scored: DataFrame, limit_mb: float = fixed.CACHE_LIMIT_MB,
                 ascending: bool = False, blocks: int | None = None) -> DataFrame:
    """Rows to evict: highest score first until enough bytes are freed per region.

    The row that crosses the target is included; a region under its limit gives none.
    Ties go by file_id.  Adds freed_before (bytes freed ahead of the row) and rank.
    Only blocks that start below the target are shuffled for the exact cut.
    """
    targets = stage(over_limit(scored, limit_mb).filter(F.col("bytes_to_free") > 0)
                    .select("region", "bytes_to_free"), "targets")
    wanted = join_same(scored, F.broadcast(targets), ["region"])     # one row per region
    by_score = F.asc("score") if ascending else F.desc("score")
    cut = order_blocks(wanted, ["region", by_score, "file_id"], blocks, "eviction")
    before = offsets(cut, ["region"], size=F.col("size"), n=F.lit(1))
    # one row per region and block in it
    started = (join_same(cut, F.broadcast(before), ["region", BLOCK])
               .filter(F.col("before_size") < F.col("bytes_to_free")))
    inside = (Window.partitionBy("region", BLOCK).orderBy(SLOT)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (started
            .withColumn("freed_before", F.col("before_size")
                        + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .filter(F.col("freed_before") < F.col("bytes_to_free"))
            .withColumn("rank", F.col(SLOT) - F.col("first_slot") + F.col("before_n") + 1)
            .drop(BLOCK, SLOT, "first_slot", "before_size", "before_n"))


def survivors(snapshot: DataFrame, evicted: DataFrame) -> DataFrame:
    return join_same(snapshot, evicted.select("region", "file_id"), ["region", "file_id"], "left_anti")


def recommendations(scored: DataFrame, n: int, by=("region",)) -> DataFrame:
    """The n highest scores per region, ranked. The filter prunes before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "file_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def lru_order(snapshot: DataFrame, blocks: int | None = None) -> DataFrame:
    """Position of each entry per region, least recent first."""
    return with_rank(snapshot, ["region"], ["last_access", "file_id"], "lru_rank", blocks)


def _run_totals(snapshot: DataFrame, evicted: DataFrame, extra: list[Column]) -> DataFrame:
    before = snapshot.groupBy("region").agg(F.sum("size").alias("_before"))
    freed = evicted.groupBy("region").agg(
        F.count("*").alias("_files"), F.sum("size").alias("_bytes"),
        F.avg("size").alias("_avg_size"), F.avg("score").alias("_avg_score"), *extra)
    return before.join(freed, "region", "left")


def _first_evicted(evicted: DataFrame, fields: list[str], n: int = 10) -> DataFrame:
    """The first n evicted rows per region as an array, in rank order."""
    return (evicted.filter(F.col("rank") <= n).groupBy("region")
            .agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("evicted_files")))


def run_metrics(snapshot: DataFrame, evicted: DataFrame, strategy: str, as_of,
                limit_mb: float = fixed.CACHE_LIMIT_MB) -> DataFrame:
    """One record per region: counts, bytes, sizes before and after, means, first ten."""
    zero = F.lit(0)
    is_lfu = strategy == "LFU"
    extra = [F.avg("frequency").alias("_avg_frequency"),
             F.avg("access_count").alias("_avg_count")] if is_lfu else []
    fields = ["file_id", "size", "score", "access_count", "last_access"] + (
        ["frequency"] if is_lfu else [])
    joined = (_run_totals(snapshot, evicted, extra)
              .join(_first_evicted(evicted, fields), "region", "left"))
    bytes_out = F.coalesce("_bytes", zero)
    score_name = f"avg_{strategy.lower()}_score"
    record = joined.select(
        scores.moment(as_of).alias("timestamp"), "region", F.lit(strategy).alias("strategy"),
        F.coalesce("_files", zero).alias("files_evicted"), bytes_out.alias("bytes_evicted"),
        (bytes_out / MB).alias("mb_evicted"), (F.col("_before") / MB).alias("cache_size_before_mb"),
        ((F.col("_before") - bytes_out) / MB).alias("cache_size_after_mb"),
        F.lit(float(limit_mb)).alias("cache_limit_mb"),
        F.coalesce("_avg_size", F.lit(0.0)).alias("avg_file_size"),
        F.coalesce("_avg_score", F.lit(0.0)).alias(score_name), "evicted_files",
        *([F.coalesce("_avg_frequency", F.lit(0.0)).alias("avg_frequency"),
           F.coalesce("_avg_count", F.lit(0.0)).alias("avg_access_count")] if is_lfu else []))
    if not is_lfu:
        return record
    stats = frequency_statistics(snapshot, by=["region"])
    names = [c for c in stats.columns if c != "region"]
    return (record.join(stats.select("region", F.struct(*names).alias("frequency_stats")),
                        "region", "left")
            .withColumn("config", F.struct(
                F.lit(fixed.DECAY_PER_HOUR).alias("decay_factor"),
                F.lit(fixed.FREQUENCY_WINDOW_HOURS).alias("time_window_hours"),
                F.lit(fixed.MIN_FREQUENCY).alias("min_frequency_threshold"))))
