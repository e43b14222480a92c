"""Ages, snapshot features and eviction scores as column expressions.

``as_of`` is always given by the caller: nothing here reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths

MB = 1024.0 * 1024.0


def moment(value) -> Column:
    """A zone-free UTC timestamp from text, a datetime or a column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def age_seconds(ts: Column, as_of) -> Column:
    """Seconds from ``ts`` to ``as_of`` as a double."""
    return paths.seconds_between(ts, moment(as_of)).cast("double")


def log_size(size: Column) -> Column:
    return F.log1p(size.cast("double"))


def log_size_at_least_one(size: Column) -> Column:
    return F.log1p(F.greatest(F.lit(1.0), size.cast("double")))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def at_least_one(count: Column) -> Column:
    return F.greatest(count, F.lit(1))


# --- access-count estimates -----------------------------------------------------

def estimated_count_by_age_and_size(kind: Column, days: Column, size: Column) -> Column:
    """Estimate for an index without counts: media by age and size, others by age."""
    media = F.floor(days * 0.5 + size / F.lit(MB) * 0.1)
    plain = F.floor(days * 0.2)
    # an age before as_of can be negative; both branches are lifted to 1 anyway
    return at_least_one(F.when(kind.isin("image", "video"), media).otherwise(plain)).cast("bigint")


def count_or_age_estimate(count: Column, days: Column) -> Column:
    """The count when it is at least 1, else an estimate from the age."""
    estimate = at_least_one(F.floor(1 + days * 0.1))
    return F.when(count >= 1, count).otherwise(estimate).cast("bigint")


# --- learned scores -------------------------------------------------------------

def lrb_parts(p: Column, distance: Column, reuse: Column, weights: dict | None = None) -> dict:
    """The three weighted parts of the learned eviction score."""
    w = weights or fixed.LRB_WEIGHTS
    return {
        "no_access": (1.0 - p) * w["binary"],
        "distance": clip(distance / fixed.MAX_DISTANCE, 0.0, 1.0) * w["distance"],
        "no_reuse": (1.0 - clip(reuse, 0.0, 1.0)) * w["reuse"],
    }


def lrb_score(p: Column, distance: Column, reuse: Column, weights: dict | None = None) -> Column:
    """Sum of the parts whose model answered; NULL when none did."""
    parts = lrb_parts(p, distance, reuse, weights)
    # clipping would turn a missing answer into a number, so ask for the answer itself
    known = [F.when(answer.isNotNull(), part) for answer, part in zip((p, distance, reuse), parts.values())]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in known[1:]), F.coalesce(known[0], F.lit(0.0)))
    return F.when(F.coalesce(*known).isNotNull(), total)


def lrb_explanation(p: Column, distance: Column, reuse: Column,
                    weights: dict | None = None) -> Column:
    return F.struct(
        (1.0 - p).alias("no_access_prob"),
        distance.cast("double").alias("predicted_distance"),
        clip(distance / fixed.MAX_DISTANCE, 0.0, 1.0).alias("distance_score"),
        reuse.cast("double").alias("reuse_prob"),
        (1.0 - clip(reuse, 0.0, 1.0)).alias("no_reuse_score"),
        lrb_score(p, distance, reuse, weights).alias("total_score"),
    )


def fallback_score(age_s: Column, count: Column) -> Column:
    """Score used when no model answers: mostly age, a little frequency."""
    return age_s / 3600.0 * 0.7 + 1.0 / at_least_one(count) * 0.3


def clean_distance(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value.cast("double"))


def clean_probability(value: Column) -> Column:
    return clip(value.cast("double"), 0.0, 1.0)


def belady_score(strategy: str, p: Column, distance: Column, reuse: Column,
                 max_distance: Column, weights: dict | None = None) -> Column:
    """Relaxed-Belady score. ``max_distance`` is the largest predicted distance."""
    share = F.when(max_distance > 0, distance / max_distance)
    if strategy == "binary":
        return 1.0 - p
    if strategy == "distance":
        return F.coalesce(share, F.lit(fixed.NEUTRAL_SCORE))
    if strategy == "reuse":
        return 1.0 - reuse
    if strategy == "lrb":
        w = weights or fixed.BELADY_WEIGHTS
        return ((1.0 - p) * w["binary"] + F.coalesce(share * w["distance"], F.lit(0.0))
                + (1.0 - reuse) * w["reuse"])
    raise ValueError(f"unknown strategy {strategy!r}")


def belady_fallback(age_s: Column, count: Column, max_age: Column) -> Column:
    return F.try_divide(age_s, max_age) * 0.6 + 1.0 / (count + 1) * 0.4


# --- LRU and LFU scores ----------------------------------------------------------

def lru_score(age_h: Column, count: Column, size: Column) -> Column:
    by_size = clip(size / F.lit(MB) / 10.0, 0.1, 1.0)
    score = age_h * (1.0 + 1.0 / at_least_one(count) * 0.1) * by_size
    return F.coalesce(score, F.lit(fixed.FAILED_SCORE))


def weighted_frequency(age_h: Column, count: Column) -> Column:
    return count * F.greatest(F.lit(0.1), 1.0 - age_h / fixed.FREQUENCY_WINDOW_HOURS)


def lfu_score(frequency: Column, age_h: Column, count: Column, size: Column) -> Column:
    base = 1.0 / F.greatest(F.coalesce(frequency, F.lit(fixed.MIN_FREQUENCY)),
                            F.lit(fixed.MIN_FREQUENCY))
    by_age = 1.0 + age_h / 168.0
    by_size = clip(size / F.lit(MB) / 10.0, 1.0, 2.0)
    rate = count / F.greatest(age_h, F.lit(1.0))
    score = base * by_age * by_size * (1.0 + 1.0 / F.greatest(rate, F.lit(0.1)))
    return F.coalesce(score, F.lit(fixed.FAILED_SCORE))


def decayed(frequency: Column, hours: Column, rate: float = fixed.DECAY_PER_HOUR) -> Column:
    """Frequency after decay: unchanged below one hour, NULL once it falls under 0.1."""
    after = frequency * F.pow(F.lit(rate), hours)
    return (F.when(hours < fixed.DECAY_MIN_HOURS, frequency)
            .when(after >= fixed.DROP_BELOW, after))
