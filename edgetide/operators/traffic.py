"""Traffic reports over probe and access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths, responses
from edgetide.operators.cleaning import successful
from edgetide.operators.ordered import (exact_median, next_marked, running_sum,
                                        with_position)


def truncated_percent(part: Column, whole: Column, decimals: int = 2) -> Column:
    """Percentage cut (not rounded) after ``decimals`` digits; NULL when whole is 0.

    Counts are whole numbers, so the cut is done by whole-number division.
    """
    scale = 10 ** decimals
    scaled = F.try_divide(part * 100 * scale - F.pmod(part * 100 * scale, F.nullif(whole, F.lit(0))),
                          whole)
    return F.round(scaled, 0) / scale


def _rows(weight: str | None, when: Column | None = None) -> Column:
    """Number of rows, or the sum of their weights; only those ``when`` holds if given."""
    if weight is None:
        return F.count("*") if when is None else F.count_if(when)
    value = F.col(weight) if when is None else F.when(when, F.col(weight)).otherwise(0)
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def totals(probes: DataFrame, weight: str | None = None) -> DataFrame:
    ok = F.col("status_code").rlike("^[23][0-9][0-9]$")
    return probes.agg(
        _rows(weight).alias("total_requests"),
        _rows(weight, ok).alias("successful_requests"),
        _rows(weight, F.col("status_code") == "FAILED").alias("failed_requests"))


def success_rate(probes: DataFrame, weight: str | None = None) -> DataFrame:
    part, whole = F.col("successful_requests"), F.col("total_requests")
    return totals(probes, weight).select(
        truncated_percent(part, whole, 2).alias("success_rate"),
        truncated_percent(part, whole, 1).alias("success_rate_short"))


def url_counts(probes: DataFrame, weight: str | None = None) -> DataFrame:
    return successful(probes).groupBy("url").agg(_rows(weight).alias("requests"))


def top_urls(probes: DataFrame, n: int = 20, weight: str | None = None) -> DataFrame:
    return url_counts(probes, weight).orderBy(F.desc("requests"), "url").limit(n)


def category_counts(probes: DataFrame, weight: str | None = None) -> DataFrame:
    return (successful(probes).groupBy(paths.url_category(F.col("url")).alias("category"))
            .agg(_rows(weight).alias("requests")))


def kind_counts(probes: DataFrame, weight: str | None = None) -> DataFrame:
    """Successful requests for .jpg, .mp4 and anything else, with truncated percents."""
    kind = (F.when(F.col("url").contains(".jpg"), "Images")
            .when(F.col("url").contains(".mp4"), "Videos").otherwise("Other"))
    kinds = ("Images", "Videos", "Other")
    counted = successful(probes).agg(
        *[_rows(weight, kind == k).alias(k) for k in kinds], _rows(weight).alias("whole"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("requests"))
                               for k in kinds]))
    return (counted.select("whole", rows.alias("r"))
            .select("r.kind", "r.requests",
                    truncated_percent(F.col("r.requests"), F.col("whole"), 1).alias("percent")))


def response_times(probes: DataFrame) -> DataFrame:
    """Mean, exact median, least and greatest response time of successful requests."""
    ok = successful(probes)
    median = exact_median(ok, "response_time").scalar()
    return ok.agg(F.avg("response_time").alias("mean"), F.min("response_time").alias("least"),
                  F.max("response_time").alias("greatest")).withColumn("median", median)


def response_times_approximate(probes: DataFrame, accuracy: int = 10000) -> DataFrame:
    """As above in a single pass, with the median to within 1 / accuracy in rank."""
    return successful(probes).agg(
        F.avg("response_time").alias("mean"), F.min("response_time").alias("least"),
        F.max("response_time").alias("greatest"),
        F.percentile_approx("response_time", 0.5, accuracy).alias("median"))


def hourly(probes: DataFrame, ts: str = "ts") -> DataFrame:
    return (successful(probes).groupBy(F.hour(ts).alias("hour"))
            .agg(F.count("*").alias("requests")))


def hourly_load(accesses: DataFrame, ts: str = "ts") -> DataFrame:
    """Requests per hour of day beside the load multiplier planned for that hour."""
    return (accesses.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("requests"))
            .withColumn("multiplier", responses.load_multiplier(F.col("hour"))))


def rank_frequency(counts: DataFrame, name: str = "url", count: str = "requests",
                   top: int | None = None, blocks: int | None = None) -> DataFrame:
    """Zipf rank of each object by count. With ``top`` only the first ranks are sorted out."""
    order = [F.desc(count), name]
    if top is not None:
        first = counts.orderBy(*order).limit(top)
        return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return with_position(counts, order, "rank", blocks).withColumn("rank", F.col("rank") + 1)


def zipf_exponent(counts: DataFrame, count: str = "requests") -> DataFrame:
    """Exponent fitted to log frequency against log rank."""
    ranked = rank_frequency(counts, count=count)
    return ranked.agg((-F.regr_slope(F.ln(count), F.ln("rank"))).alias("exponent"))


def zipf_weight(kind: Column, index: Column, exponent: float = fixed.ZIPF_EXPONENT) -> Column:
    """Weight of the index-th object of its kind."""
    return paths.one_of(kind, fixed.ZIPF_NUMERATOR) / F.pow(index, F.lit(exponent))


def cumulative_probability(weights: DataFrame, order, weight: str = "weight",
                           blocks: int | None = None) -> DataFrame:
    """Add prob and cum_prob in the given (unique) order."""
    total = weights.select(F.sum(weight)).scalar()
    return (running_sum(weights, [], order, weight, "_upto", blocks)
            .withColumns({"prob": F.col(weight) / total, "cum_prob": F.col("_upto") / total})
            .drop("_upto"))


def uniform_draw(key: Column) -> Column:
    """A repeatable number in [0, 1) from a key: the first 52 bits of its md5."""
    bits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10)
    return bits.cast("bigint") / F.lit(float(1 << 52))


def draw_items(draws: DataFrame, catalogue: DataFrame, item: str, u: str = "u",
               blocks: int | None = None) -> DataFrame:
    """The catalogue item whose cumulative range (lo, hi] holds each draw.

    ``catalogue`` has ``cum_prob`` as hi.  Items and draws are put in one order and each
    draw takes the next item: one range shuffle, no pairing of draws with items.  A draw
    above the last bound takes the last item.
    """
    others = [c for c in draws.columns if c != u]
    marks = catalogue.select(
        F.col("cum_prob").alias(u), F.lit(1).alias("_mark"), F.col(item).alias("_item"),
        F.xxhash64(item).alias("_tie"),
        *[F.lit(None).cast(draws.schema[c].dataType).alias(c) for c in others])
    asked = draws.select(u, F.lit(0).alias("_mark"),
                         F.lit(None).cast(catalogue.schema[item].dataType).alias("_item"),
                         F.xxhash64(*others).alias("_tie"), *others)
    filled = next_marked(asked.unionByName(marks), [u, "_mark", "_tie"], "_item", item, blocks)
    last = catalogue.select(F.max_by(item, "cum_prob")).scalar()
    return (filled.filter(F.col("_mark") == 0)
            .withColumn(item, F.coalesce(item, last)).drop("_mark", "_item", "_tie"))


def boosted_weights(weights: DataFrame, schedule: DataFrame, days: DataFrame) -> DataFrame:
    """Weight per (day, object), times five where the schedule lists the pair.

    ``days`` is (file_id, day) pairs that occur; ``schedule`` is (file_id, day).
    """
    flagged = schedule.select("file_id", "day", F.lit(True).alias("_trending")).distinct()
    return (days.join(weights, "file_id").join(flagged, ["file_id", "day"], "left")
            .withColumn("weight", F.when(F.col("_trending"), F.col("weight") * fixed.TREND_BOOST)
                        .otherwise(F.col("weight"))).drop("_trending"))


def per_day(accesses: DataFrame, ts: str = "ts") -> DataFrame:
    """Accesses per object and day, long form."""
    return (accesses.groupBy("file_id", F.to_date(ts).alias("day"))
            .agg(F.count("*").alias("requests")))


def per_day_matrix(accesses: DataFrame, ts: str = "ts") -> DataFrame:
    """Object x day matrix over every date of the log: ``counts`` has one number per date from
    ``first_day`` on, 0 where the object was not read."""
    days = accesses.groupBy("file_id", F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    span = accesses.agg(F.min(F.to_date(ts)), F.max(F.to_date(ts))).first()
    lo, hi = (F.lit(day).cast("date") for day in span)
    per_object = days.groupBy("file_id").agg(F.map_from_entries(
        F.collect_list(F.struct("day", "n"))).alias("by_day"))      # one entry per date
    return per_object.select("file_id", lo.alias("first_day"), F.transform(
        F.sequence(lo, hi), lambda d: F.coalesce(F.element_at("by_day", d), F.lit(0))).alias("counts"))


def availability(probes: DataFrame, ts: str = "ts", slot: str = "30 seconds") -> DataFrame:
    """Share of probes with status 200 per slot."""
    return (probes.groupBy(F.window(ts, slot)).agg(
        F.count("*").alias("probes"),
        F.avg((F.col("status_code") == "200").cast("double")).alias("available"))
        .select(F.col("window.start").alias("slot"), "probes", "available"))


