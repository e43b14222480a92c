"""Block-wise steps against plain Python, over many blocks and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from edgetide.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        data.append((i, key, rng.randrange(500), rng.randrange(1, 100)))
    return data, spark.createDataFrame(data, "id long, key string, v long, size long").repartition(5)


def test_position(rows):
    data, frame = rows
    got = {r.id: r.pos for r in ordered.with_position(frame, ["v", "id"], blocks=7).collect()}
    want = {row[0]: i for i, row in enumerate(sorted(data, key=lambda r: (r[2], r[0])))}
    assert got == want


def test_blocks_stay_even_under_a_hot_value(rows):
    _, frame = rows
    cut = ordered.order_blocks(frame.withColumn("v", F.lit(1)), ["v", "id"], blocks=8)
    sizes = [r["count"] for r in cut.groupBy(ordered.BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 3000 / 8


def test_rank_descending_within_keys(rows):
    data, frame = rows
    got = {r.id: r["rank"] for r in
           ordered.with_rank(frame, ["key"], [F.desc("v"), "id"], blocks=7).collect()}
    want = {}
    for key in {r[1] for r in data}:
        for i, row in enumerate(sorted((r for r in data if r[1] == key), key=lambda r: (-r[2], r[0]))):
            want[row[0]] = i + 1
    assert got == want


def test_running_sum(rows):
    data, frame = rows
    got = {r.id: r.upto for r in
           ordered.running_sum(frame, ["key"], ["v", "id"], "size", "upto", blocks=6).collect()}
    want = {}
    for key in {r[1] for r in data}:
        total = 0
        for row in sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0])):
            total += row[3]
            want[row[0]] = total
    assert got == want


def test_next_marked(rows):
    data, frame = rows
    marked = frame.withColumn("mark", F.when(F.col("id") % 97 == 0, F.col("id")))
    got = {r.id: r.nxt for r in ordered.next_marked(marked, ["id"], "mark", "nxt", blocks=6).collect()}
    for i in got:
        want = -(-i // 97) * 97
        assert got[i] == (want if want < 3000 else None)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_median(spark, n):
    rng = random.Random(n)
    xs = sorted(rng.choice([1.5, 2.5, rng.random()]) for _ in range(n))
    frame = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").repartition(4)
    want = (xs[(n - 1) // 2] + xs[n // 2]) / 2
    assert ordered.exact_median(frame, "x", blocks=3).first()[0] == pytest.approx(want)


def test_median_of_nothing(spark):
    assert ordered.exact_median(spark.createDataFrame([], "x double"), "x").first()[0] is None


def test_group_total_for_hot_and_cold_keys(rows):
    data, frame = rows
    counts = {}
    for r in data:
        counts[r[1]] = counts.get(r[1], 0) + 1
    got = ordered.group_total(frame, "key", "id", "n").collect()
    assert len(got) == 3000 and all(r.n == counts[r.key] for r in got)
