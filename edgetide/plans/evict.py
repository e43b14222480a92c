"""Eviction plans per policy: what to evict, what stays, and the run's record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.operators import cleaning, eviction, snapshot as snapshots
from edgetide.operators.ordered import join_same
from edgetide.sources import cache_indexes
from edgetide.staging import stage


@dataclass
class Plan:
    """The plan of one policy for all regions. ``entries`` is the scored snapshot.

    ``broken`` are index entries no policy can judge; they stay in the index.
    """

    policy: str
    entries: DataFrame
    evicted: DataFrame
    as_of: object
    limit_mb: float
    broken: DataFrame | None = None

    @property
    def survivors(self) -> DataFrame:
        return eviction.survivors(self.entries, self.evicted)

    @property
    def metrics(self) -> DataFrame:
        return eviction.run_metrics(self.entries, self.evicted, self.policy, self.as_of,
                                    self.limit_mb)


def _plan(policy: str, scored: DataFrame, as_of, limit_mb: float, ascending: bool = False) -> Plan:
    # scores feed the totals, the cut, the survivors and the metrics: write them once
    entries = stage(scored, "scored")
    # survivors, metrics and recommendations read the cut: write it once
    evicted = stage(eviction.eviction_cut(entries, limit_mb, ascending), "evicted")
    return Plan(policy, entries, evicted, as_of, limit_mb)


def plan_lru(snapshot: DataFrame, as_of, limit_mb: float = fixed.CACHE_LIMIT_MB) -> Plan:
    return _plan("LRU", eviction.lru_scored(snapshot, as_of), as_of, limit_mb)


def plan_lfu(snapshot: DataFrame, as_of, limit_mb: float = fixed.CACHE_LIMIT_MB,
             tracker: DataFrame | None = None, hours: float = 0.0) -> Plan:
    """LFU plan; with a ``tracker`` of earlier frequencies the larger value counts."""
    current = snapshots.with_frequency(snapshot, as_of)
    if tracker is not None:
        merged = snapshots.decay_and_merge(tracker, current, hours)
        current = join_same(current.drop("frequency"), merged, ["region", "file_id"])
    return _plan("LFU", eviction.lfu_scored(current), as_of, limit_mb)


def plan_lrb(features: DataFrame, limit_mb: float = fixed.CACHE_LIMIT_MB, as_of=None,
             weights: dict | None = None) -> Plan:
    """Learned plan over rows with p, distance and reuse."""
    return _plan("LRB", eviction.lrb_scored(features, weights), as_of, limit_mb)


def plan_belady(features: DataFrame, strategy: str = "lrb",
                limit_mb: float = fixed.CACHE_LIMIT_MB, as_of=None) -> Plan:
    return _plan("BELADY", eviction.belady_scored(features, strategy), as_of, limit_mb)


def plan_hit_probability(features: DataFrame, limit_mb: float = fixed.CACHE_LIMIT_MB,
                         as_of=None) -> Plan:
    """The older plan: lowest probability of a hit goes first."""
    scored = features.withColumn("score", F.col("p"))
    return _plan("HITPROB", scored, as_of, limit_mb, ascending=True)


INDEX_COLUMNS = ("region", "file_id", "last_access", "size", "type", "access_count")


def publish_survivors(plan: Plan, path: str) -> None:
    """The index after the plan: all survivors, and broken entries as they were."""
    kept = plan.survivors.withColumn(
        "last_access", F.date_format("last_access", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).select(*INDEX_COLUMNS)
    if plan.broken is not None:
        kept = kept.unionByName(plan.broken.select(*INDEX_COLUMNS))
    cache_indexes.write_index_lines(kept, path)


def from_index(spark: SparkSession, pattern: str, policy: str, as_of, limit_mb: float = fixed.CACHE_LIMIT_MB,
               predict: Callable[[DataFrame], DataFrame] | None = None, publish_to: str | None = None,
               **options) -> Plan:
    """The whole run of an edge's evictor, for all regions: load, validate, enrich, score, cut, publish.

    ``pattern`` finds index files (``cache_indexes.read_regional_indexes``) or is the folder of a published
    index.  The learned policies LRB, BELADY and HITPROB need ``predict``, which adds p, distance and
    reuse to the serving features.  An index that is read is never changed: ``publish_to`` gets
    the next version.  ``options`` go to the policy's plan and to the scan (``indent``, ``whole_files``).
    """
    scan = {k: options.pop(k) for k in ("indent", "whole_files") if k in options}
    raw = (cache_indexes.read_regional_indexes(spark, pattern, **scan) if "cache_index_" in pattern
           else cache_indexes.read_index_lines(spark, pattern))
    entries = stage(raw, "index")
    valid = cleaning.valid_entries(entries)
    if policy == "LRU":
        plan = plan_lru(valid, as_of, limit_mb, **options)
    elif policy == "LFU":
        plan = plan_lfu(valid, as_of, limit_mb, **options)
    else:
        if predict is None:
            raise ValueError(f"{policy} needs predict")
        make = {"LRB": plan_lrb, "BELADY": plan_belady, "HITPROB": plan_hit_probability}[policy]
        plan = make(predict(snapshots.serving_features(valid, as_of)), limit_mb=limit_mb, as_of=as_of, **options)
    plan.broken = cleaning.broken_entries(entries)
    if publish_to is not None:
        publish_survivors(plan, publish_to)
    return plan


def compare_policies(plans: dict[str, Plan]) -> DataFrame:
    """Evictions of several policies in one table."""
    out = None
    for name, plan in plans.items():
        one = plan.evicted.withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
