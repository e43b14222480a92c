"""Null keys, late batches, missing models and repeated changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edgetide.operators import content, eviction, ordered, snapshot, trace
from edgetide.plans import evict

DAY = dt.datetime(2024, 1, 1)
ROWS = [("eu", "a", DAY, 1), ("eu", None, DAY + dt.timedelta(hours=1), 2), (None, "a", DAY + dt.timedelta(hours=2), 3),
        ("eu", None, DAY + dt.timedelta(hours=3), 4), (None, None, DAY + dt.timedelta(hours=4), 5),
        ("eu", "a", DAY + dt.timedelta(hours=5), 6)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, "cdn_region string, file_id string, ts timestamp_ntz, key long")


def test_history_keeps_null_keys(log):
    by = ("cdn_region", "file_id")
    rows = trace.history(trace.positioned(log, "key", blocks=3), by).collect()
    assert {r.key: r.access_count for r in rows} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 2}


def test_state_neither_multiplies_nor_moves_back(log):
    by = ("cdn_region", "file_id")
    state = None
    for days in (0, 1, -1):
        rows = trace.positioned(log.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {days} DAY")), "key")
        state = trace.object_state(rows, by, state=state)
    got = {(r.cdn_region, r.file_id): (r.state_count, r.state_last.ts) for r in state.collect()}
    assert len(got) == 4 and got[("eu", "a")] == (6, DAY + dt.timedelta(days=1, hours=5))
    assert got[(None, None)] == (3, DAY + dt.timedelta(days=1, hours=4))


@pytest.mark.parametrize("blocks", [1, 4])
def test_rank_and_running_sum_keep_null_keys(log, blocks):
    ranks = ordered.with_rank(log, ["file_id"], ["ts", "key"], blocks=blocks).collect()
    assert {r.key: r.rank for r in ranks} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3}
    sums = ordered.running_sum(log, ["file_id"], ["ts", "key"], "key", "total", blocks).collect()
    assert {r.key: r.total for r in sums} == {1: 1, 2: 2, 3: 4, 4: 6, 5: 11, 6: 10}


def predictions(spark, rows):
    return spark.createDataFrame(rows, "region string, file_id string, size long, p double, distance double, "
                                       "reuse double, age_since_last_access double, access_count long")


def test_missing_models(spark):
    rows = [("eu", "a", 600_000, 0.5, None, 0.5, 10.0, 1), ("eu", "b", 600_000, None, None, None, 7200.0, 1),
            ("us", "c", 600_000, None, None, None, 3600.0, 2), (None, "d", 900_000, 0.1, 10.0, 0.2, 1.0, 1),
            (None, "e", 900_000, 0.9, 10.0, 0.2, 1.0, 1)]
    got = {r.file_id: round(r.score, 6) for r in eviction.lrb_scored(predictions(spark, rows)).collect()}
    w = {"binary": 0, "distance": 0, "reuse": 0}
    from edgetide.functions import fixed_values as fixed
    w = fixed.LRB_WEIGHTS
    assert got["a"] == round(0.5 * w["binary"] + 0.5 * w["reuse"], 6)
    assert got["b"] == round(2 * 0.7 + 0.3, 6) and got["c"] == round(0.7 + 0.15, 6)
    plan = evict.plan_lrb(predictions(spark, rows), limit_mb=1, as_of="2024-01-02 00:00:00")
    assert {(r.region, r.file_id) for r in plan.evicted.collect()} == {("eu", "b"), (None, "d")}
    assert {r.file_id for r in plan.survivors.collect()} == {"a", "c", "e"}


def test_index_keeps_the_newest_access_of_unknown_size(spark):
    rows = [("eu", "a", DAY, 5, 200, "/a.jpg"), ("eu", "a", DAY + dt.timedelta(days=1), None, 200, "/a.jpg")]
    frame = spark.createDataFrame(rows, "cdn_region string, file_id string, ts timestamp_ntz, size long, status int, path string")
    got = snapshot.index_from_log(frame).first()
    assert got.last_access == DAY + dt.timedelta(days=1) and got["size"] is None and got.access_count == 2


def test_newest_change_counts(spark):
    held = spark.createDataFrame([(1, "old"), (2, "stays")], "id long, title string")
    changes = spark.createDataFrame([(1, "newer", False, 2), (1, "new", False, 1), (3, "gone", True, 9), (3, "was", False, 3)],
                                    "id long, title string, deleted boolean, n long")
    got = content.apply_changes(held, changes, "n").select("id", "title").collect()
    assert sorted(map(tuple, got)) == [(1, "newer"), (2, "stays")]


def test_every_value_has_a_code(spark):
    frame = spark.createDataFrame([("image",), ("font",), (None,), ("zip",), ("image",)], "type string")
    got = sorted(snapshot.alphabetical_code(frame, "type").collect(), key=str)
    assert {(r.type, r.code) for r in got} == {("font", 0), ("image", 1), ("zip", 2), (None, None)}
