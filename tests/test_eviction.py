"""Properties of eviction plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from edgetide.operators import eviction
from edgetide.plans import evict

AS_OF = "2024-02-01 00:00:00"
MB = 1024 * 1024


@pytest.fixture(scope="module")
def snapshot(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        # one region holds most of the entries; one stays under the limit
        region = "big" if i % 10 else ("small" if i % 20 else "tiny")
        size = 1000 if region == "tiny" else rng.randrange(1, MB)
        rows.append((region, f"f{i:04d}", datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(10 ** 6)),
                     size, rng.randrange(1, 50), "image"))
    schema = ("region string, file_id string, last_access timestamp_ntz, size bigint, "
              "access_count bigint, type string")
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.mark.parametrize("blocks", [None, 1, 13])
def test_cut_is_the_walk(snapshot, blocks):
    scored = eviction.lru_scored(snapshot, AS_OF)
    got = {}
    for r in eviction.eviction_cut(scored, 10, blocks=blocks).collect():
        got.setdefault(r.region, []).append((r["rank"], r.file_id))
    entries = {}
    for r in scored.collect():
        entries.setdefault(r.region, []).append((-r.score, r.file_id, r.size))
    for region, rows in entries.items():
        target = sum(r[2] for r in rows) - 10 * MB
        want, freed = [], 0
        for n, (_, name, size) in enumerate(sorted(rows)):
            if freed >= target:
                break
            freed += size
            want.append((n + 1, name))
        assert sorted(got.get(region, [])) == want


def test_plan_parts_fit_together(snapshot):
    plan = evict.plan_lfu(snapshot, AS_OF, 10)
    keys = lambda df: {(r.region, r.file_id) for r in df.select("region", "file_id").collect()}
    gone, kept = keys(plan.evicted), keys(plan.survivors)
    assert not gone & kept and gone | kept == keys(snapshot)
    by_region = {r.region: r for r in plan.metrics.collect()}
    assert by_region["tiny"].files_evicted == 0 and by_region["tiny"].evicted_files is None
    assert by_region["tiny"].avg_lfu_score == 0.0 and by_region["tiny"].avg_frequency == 0.0
    big = by_region["big"]
    assert big.cache_size_after_mb <= 10 and len(big.evicted_files) == 10
    assert [e["rank"] for e in big.evicted_files] == list(range(1, 11))
    assert big.config["decay_factor"] == 0.99 and big.frequency_stats["total_tracked"] == 810


def test_total_at_the_limit_evicts_nothing(spark):
    row = [("r", "a", datetime(2024, 1, 1), 5 * MB, 1, "image")]
    snap = spark.createDataFrame(row, "region string, file_id string, last_access timestamp_ntz, "
                                      "size bigint, access_count bigint, type string")
    assert evict.plan_lru(snap, AS_OF, 5).evicted.count() == 0
    assert evict.plan_lru(snap, AS_OF, 4.9).evicted.count() == 1


def test_empty_snapshot(snapshot):
    plan = evict.plan_lru(snapshot.filter("false"), AS_OF, 5)
    assert plan.evicted.count() == 0 and plan.metrics.count() == 0


def test_tracker_keeps_an_older_larger_frequency(spark, snapshot):
    tracker = snapshot.select("region", "file_id", F.lit(1000.0).alias("frequency"))
    scored = evict.plan_lfu(snapshot, AS_OF, 10, tracker, hours=2.0).entries
    assert scored.agg(F.min("frequency")).first()[0] == pytest.approx(1000 * 0.99 ** 2)
