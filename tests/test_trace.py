"""Trace labels, features and LRU against a sequential replay."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.operators import trace
from edgetide.staging import stage


def replay(objects, capacity):
    """Plain sequential LRU: (hit, stack position from the least recent end)."""
    cache, out = OrderedDict(), []
    for name in objects:
        if name in cache:
            out.append((1, list(cache).index(name) + 1))
            cache.move_to_end(name)
        else:
            out.append((0, len(cache) + 1))
            if len(cache) >= capacity:
                cache.popitem(last=False)
            cache[name] = True
    return out


def random_objects(seed, n, kinds):
    rng = random.Random(seed)
    return [f"o{min(int(rng.expovariate(0.15)), kinds)}" for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_smaller_before(seed):
    values = np.random.default_rng(seed).integers(-1, 30, 200)
    want = [int((values[:i] < values[i]).sum()) for i in range(len(values))]
    assert trace.smaller_before(values).tolist() == want


def frame_of(spark, objects, seed=1):
    rng = random.Random(seed)
    ts, rows = datetime(2024, 1, 1), []
    for i, name in enumerate(objects):
        # several accesses share an instant, so the key decides their order
        ts += timedelta(seconds=rng.choice([0, 0, 1, 7]))
        rows.append((i, ts, name))
    schema = "event_id long, ts timestamp_ntz, file_id string"
    return rows, spark.createDataFrame(rows, schema).repartition(4)


@pytest.mark.parametrize("seed,size,blocks", [(9, 600, 11), (3, 500, 1), (4, 400, 25), (5, 1, 3)])
def test_one_table_for_every_capacity(spark, seed, size, blocks):
    objects = random_objects(seed, size, 40)
    _, frame = frame_of(spark, objects)
    rows = stage(trace.stack_distances(trace.positioned(frame, "event_id", blocks=blocks)), "distances")
    for capacity in (1, 5, 12, 100):
        got = {r.pos: (r.hit, r.stack_distance_approx) for r in trace.lru_columns(rows, capacity).collect()}
        assert [got[i] for i in range(size)] == replay(objects, capacity)


def test_a_cache_per_region(spark):
    rng = random.Random(7)
    objects = [None if rng.random() < .05 else name for name in random_objects(2, 700, 30)]
    regions = [rng.choice(["sea", "sea", "sea", "eu", None]) for _ in objects]
    rows, _ = frame_of(spark, objects)
    frame = spark.createDataFrame([(*r, g) for r, g in zip(rows, regions)],
                                  "event_id long, ts timestamp_ntz, file_id string, region string").repartition(3)
    by = ("region",)
    got = {r.event_id: (r.hit, r.stack_distance_approx) for r in trace.with_lru(
        trace.positioned(frame, "event_id", blocks=9, by=by), 6, by).collect()}
    for region in ("sea", "eu", None):
        own = [i for i, g in enumerate(regions) if g == region]
        assert [got[i] for i in own] == replay([objects[i] for i in own], 6)


def test_history_and_labels_over_blocks(spark):
    objects = ["hot" if i % 3 else f"o{i % 7}" for i in range(400)]
    rows, frame = frame_of(spark, objects)
    cut = trace.positioned(frame, "event_id", blocks=9)
    got = {r.event_id: r for r in trace.look_ahead(trace.history(cut), base=cut, window=10).collect()}
    seen, last = {}, {}
    for i, ts, name in rows:
        r = got[i]
        seen[name] = seen.get(name, 0) + 1
        age = (ts - last[name]).total_seconds() if name in last else 0.0
        last[name] = ts
        assert r.pos == i and r.access_count == seen[name]
        assert r.age_since_last_access == pytest.approx(age)
        assert r.access_rate == pytest.approx(seen[name] / (age / 3600) if age else seen[name])
        later = [j - i for j in range(i + 1, 400) if objects[j] == name]
        assert r.next_access_distance == (later[0] if later else 30)
        weight = min(1.0, sum(1 / d for d in later[:5] if d <= 10))
        assert r.future_reuse_prob == pytest.approx(weight)
        assert r.will_be_accessed_in_n == int(bool(later) and later[0] <= 10)


def test_history_goes_on_from_a_state(spark):
    objects = random_objects(3, 300, 10)
    _, frame = frame_of(spark, objects)
    whole = {r.event_id: (r.access_count, r.age_since_last_access) for r in
             trace.history(trace.positioned(frame, "event_id")).collect()}
    first = trace.positioned(frame.filter("event_id < 120"), "event_id", blocks=3)
    second = trace.positioned(frame.filter("event_id >= 120"), "event_id", blocks=3)
    state = trace.object_state(first)
    parts = trace.history(first).collect() + trace.history(second, state=state).collect()
    assert {r.event_id: (r.access_count, r.age_since_last_access) for r in parts} == whole
    both = trace.object_state(second, state=state)
    assert both.agg(F.sum("state_count")).first()[0] == 300


def test_empty_trace(spark):
    frame = spark.createDataFrame([], "event_id long, ts timestamp_ntz, file_id string")
    cut = trace.positioned(frame, "event_id")
    assert trace.with_lru(trace.look_ahead(trace.history(cut), base=cut), 5).count() == 0
