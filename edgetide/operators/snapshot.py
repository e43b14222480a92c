"""Cache snapshots: built from the log, typed through the cache key, enriched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths, responses, scores
from edgetide.operators.ordered import join_same, with_position


def index_from_log(accesses: DataFrame) -> DataFrame:
    """Per region and object: last access, its size, type and access count.

    Only good statuses count; of accesses at the same instant the largest size is
    taken.  Time and size travel in one decimal and the type as its ordinal, because
    aggregates over fixed-width values hash and combine before the shuffle, while
    strings and structs would be sorted first.
    """
    ok = accesses.filter(F.col("status").isin(fixed.OK_STATUSES))
    shift = F.lit(10 ** 15).cast("decimal(16,0)")
    micros = paths.epoch_micros(F.col("ts")).cast("decimal(19,0)")
    # the size is one more than it is, so that 0 stands for an unknown one
    size = F.coalesce(F.col("size") + 1, F.lit(0)).cast("decimal(15,0)")
    packed = F.max((micros * shift + size).cast("decimal(38,0)"))
    last = F.floor(F.col("_last") / shift)
    names = {code: name for name, code in fixed.CLASS_ORDINAL.items()}
    return (ok.groupBy(F.col("cdn_region").alias("region"), "file_id")
            .agg(packed.alias("_last"), F.count("*").alias("access_count"),
                 F.min(paths.class_ordinal(paths.media_type(F.col("path")))).alias("_class"))
            .select("region", "file_id",
                    F.timestamp_add("MICROSECOND", last.cast("bigint"),
                                    F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
                    .alias("last_access"),
                    (F.nullif(F.pmod("_last", shift).cast("bigint"), F.lit(0)) - 1).alias("size"),
                    "access_count",
                    paths.one_of(F.col("_class"), names).alias("type")))


def types_by_hash(requests: DataFrame, **key_parts: str) -> DataFrame:
    """Distinct (hash, type) of logged media paths; the type follows from the path."""
    return (requests.select("path", "type").distinct()
            .select(responses.cache_hash(F.col("path"), **key_parts).alias("hash"), "type"))


def resolve_types(files: DataFrame, types: DataFrame) -> DataFrame:
    """Give each cached file the type logged for its hash, else ``other``."""
    return (files.join(types.select("hash", F.col("type").alias("_type")), "hash", "left")
            .withColumn("type", F.coalesce("_type", F.lit("other"))).drop("_type"))


def serving_features(snapshot: DataFrame, as_of) -> DataFrame:
    """Features of cached objects at ``as_of``, from their index entries."""
    count = F.greatest(F.coalesce("access_count", F.lit(1)), F.lit(1))
    age = scores.age_seconds(F.col("last_access"), as_of)
    return (snapshot
            .withColumns({"type": paths.keep_known_class(F.coalesce("type", F.lit("other"))),
                          "access_count": count, "size": F.coalesce("size", F.lit(0)),
                          "age_since_last_access": age})
            .withColumn("age_hours", F.col("age_since_last_access") / 3600.0)
            .withColumns({
                "type_encoded": paths.class_ordinal(F.col("type")),
                "log_file_size": scores.log_size(F.col("size")),
                "access_rate": F.col("access_count") / F.greatest("age_hours", F.lit(0.1)),
                "recency_score": 1.0 / (1.0 + F.col("age_hours")),
                "stack_distance_approx": F.col("size") / (F.col("access_count") + 1)}))


def alternative_features(snapshot: DataFrame, as_of) -> DataFrame:
    """The older feature set: rates damped by +1 and by a base-2 logarithm."""
    return (snapshot
            .withColumn("age_since_last_access", scores.age_seconds(F.col("last_access"), as_of))
            .withColumn("age_hours", F.col("age_since_last_access") / 3600.0)
            .withColumns({
                "age_days": F.col("age_since_last_access") / 86400.0,
                "log_file_size": scores.log_size_at_least_one(F.col("size")),
                "access_rate": F.col("access_count") / (F.col("age_hours") + 1),
                "recency_score": F.col("access_count") / F.log2(F.col("age_hours") + 2),
                "stack_distance_approx": F.col("size") / (F.col("access_count") + 1)}))


def hit_model_features(snapshot: DataFrame, as_of) -> DataFrame:
    """The four features of the older hit model; its access count is a stand-in."""
    rows = snapshot.withColumns({
        "access_count": paths.underscores(F.col("file_id")),
        "age_since_last_access": scores.age_seconds(F.col("last_access"), as_of),
        "file_type": paths.keep_known_class(F.col("type"), fixed.BELADY_TYPES),
        "log_file_size": scores.log_size_at_least_one(F.col("size"))})
    return alphabetical_code(rows, "file_type", "file_type_encoded")


def model_row(features: DataFrame, order=tuple(fixed.MODEL_FEATURES), keep=("file_id",)
              ) -> DataFrame:
    """The model's columns in its order; absent or NULL ones take their defaults."""
    def value(name: str) -> Column:
        if name == "log_file_size":
            size = F.coalesce("size", F.lit(0)) if "size" in features.columns else F.lit(0)
            default = scores.log_size(size)
        else:
            default = F.lit(fixed.FEATURE_DEFAULTS[name])
        return (F.coalesce(name, default) if name in features.columns else default).alias(name)
    return features.select(*keep, *[value(n) for n in order])


def missing_features(features: DataFrame, required=tuple(fixed.MODEL_FEATURES)) -> list[str]:
    """Required columns that are absent; a schema test, no job."""
    return sorted(set(required) - set(features.columns))


def alphabetical_code(rows: DataFrame, column: str, name: str = "code") -> DataFrame:
    """0-based alphabetical rank of ``column`` over all values present; NULL has none."""
    values = rows.select(F.col(column).alias("_value")).filter(F.col(column).isNotNull()).distinct()
    codes = with_position(values, ["_value"], "_code")
    return (rows.join(codes, F.col(column) == F.col("_value"), "left")
            .withColumn(name, F.col("_code").cast("int")).drop("_value", "_code"))


def bytes_in_use(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("region").agg(F.sum("size").alias("bytes_used"))


def over_limit(snapshot: DataFrame, limit_mb: float = fixed.CACHE_LIMIT_MB) -> DataFrame:
    """Bytes in use and bytes to free per region (0 when under the limit)."""
    limit = int(limit_mb * 1024 * 1024)
    return bytes_in_use(snapshot).withColumns({
        "over": F.col("bytes_used") > limit,
        "bytes_to_free": F.greatest(F.col("bytes_used") - limit, F.lit(0)).cast("bigint")})


def with_frequency(snapshot: DataFrame, as_of) -> DataFrame:
    """Access count repaired, age and weighted frequency added."""
    age = scores.age_seconds(F.col("last_access"), as_of)
    return (snapshot
            .withColumn("age_hours", age / 3600.0)
            .withColumn("access_count", scores.count_or_age_estimate(
                F.col("access_count"), F.col("age_hours") / 24.0))
            .withColumn("frequency", scores.weighted_frequency(
                F.col("age_hours"), F.col("access_count"))))


def decay_and_merge(tracker: DataFrame, current: DataFrame, hours: Column | float,
                    keys=("region", "file_id")) -> DataFrame:
    """One step of the frequency state: decay, drop small, then the larger of old and new."""
    hours = F.lit(float(hours)) if not isinstance(hours, Column) else hours
    old = (tracker.withColumn("_old", scores.decayed(F.col("frequency"), hours))
           .filter(F.col("_old").isNotNull()).select(*keys, "_old"))
    new = current.select(*keys, F.col("frequency").alias("_new"))
    return (join_same(old, new, list(keys), "full_outer")
            .select(*keys, F.greatest(F.coalesce("_old", F.lit(0.0)), F.coalesce("_new", F.lit(0.0)))
                    .alias("frequency")))


def frequency_statistics(frequencies: DataFrame, value: str = "frequency", by=()) -> DataFrame:
    f = F.col(value)
    return frequencies.groupBy(*by).agg(
        F.count(f).alias("total_tracked"), F.avg(f).alias("avg_frequency"),
        F.min(f).alias("min_frequency"), F.max(f).alias("max_frequency"),
        F.count_if(f < 2.0).alias("low_freq_count"), F.count_if(f > 10.0).alias("high_freq_count"))
