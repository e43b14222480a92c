"""The leaky bucket against a sequential one, over many blocks and a hot client."""

import random
from datetime import datetime, timedelta

import pytest

from edgetide.operators import rate_limits

START = datetime(2025, 6, 1)
SCHEMA = "id long, zone string, ip string, ts timestamp_ntz"


def sequential(rows, limits):
    """The edge's rule, request by request."""
    state, out = {}, {}
    for _, zone, ip, ts in sorted((r for r in rows if None not in r and r[1] in limits), key=lambda r: r[3]):
        rate, burst = limits[zone]
        ms = (ts - START) // timedelta(milliseconds=1)
        excess, last = state.get((zone, ip), (0, None))
        level = 0 if last is None else max(0, excess - rate * (ms - last) + 1000)
        seen = out.setdefault((zone, ip, START + timedelta(milliseconds=ms)), [0, 0])
        seen[0] += 1
        if level <= burst * 1000:
            state[zone, ip] = level, ms
            seen[1] += 1
    return {(*k, n, ok, n - ok) for k, (n, ok) in out.items()}


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def found(frame):
    return {(r.zone, r.ip, r.instant, r.requests, r.accepted, r.refused) for r in frame.collect()}


def dense(n, seconds, seed=1):
    """A third of all requests from one client, the rest from a few others, some at one instant."""
    rng = random.Random(seed)
    return [(i, rng.choice(["media", "api", "page"]), "hot" if rng.random() < 0.34 else f"c{rng.randrange(30)}",
             START + timedelta(microseconds=rng.choice([rng.randrange(seconds * 10**6), 500_000])))
            for i in range(n)]


@pytest.mark.parametrize("limits", [{"media": (50, 20), "api": (10, 0)}, {"media": (7, 3), "page": (1, 100)}])
@pytest.mark.parametrize("blocks", [1, 9])
def test_equals_a_sequential_bucket(spark, limits, blocks):
    rows = dense(6000, 20)
    got = found(rate_limits.leaky_bucket(made(spark, rows), limits, blocks=blocks))
    assert got == sequential(rows, limits)
    assert any(r[5] for r in got) and any(r[4] for r in got)


def test_one_busy_client_over_all_blocks(spark):
    """No pause long enough to drain: the level is carried through blocks that have no start of their own."""
    rng = random.Random(3)
    rows = [(i, "media", "hot", START + timedelta(milliseconds=20 * i + rng.randrange(12) - 3 * (i % 5)))
            for i in range(4000)]
    got = found(rate_limits.leaky_bucket(made(spark, rows), {"media": (49, 4)}, blocks=12))
    assert got == sequential(rows, {"media": (49, 4)})
    assert sum(r[5] for r in got) > 10


def test_exits_of_a_block_equal_a_replay_from_every_level():
    import numpy as np
    rng = np.random.default_rng(2)
    for rate, burst in ((50, 2000), (10, 0), (7, 1000)):
        gap = rng.integers(1, 2 * 1000 // rate, 300)
        gap = np.minimum(gap, (burst + 1000 - 1) // rate)
        count, r, b = rng.integers(1, 3, 300), np.full(300, rate), np.full(300, burst)
        for size in (1, 5, 300):
            exits = rate_limits.exits_of(gap[:size], count[:size], r[:size], b[:size])
            want = [rate_limits._replay(int(x), gap[:size], count[:size], r[:size], b[:size])[1][-1]
                    for x in rate_limits.lattice(rate, burst)]
            assert want == (exits.tolist() if len(exits) > 1 else exits.tolist() * len(want))


def test_odd_rows(spark):
    at = START + timedelta(milliseconds=5)
    rows = [(1, "api", "a", at), (2, "api", "a", at), (3, "api", None, at), (4, None, "a", at), (5, "api", "a", None),
            (6, "none", "a", at), (7, "api", "", at), (8, "media", "a", at)]
    limits = {"media": (50, 20), "api": (10, 0)}
    replayed = rate_limits.leaky_bucket(made(spark, rows), limits)
    assert found(replayed) == {("api", "a", at, 2, 1, 1), ("api", "", at, 1, 1, 0), ("media", "a", at, 1, 1, 0)}
    got = rate_limits.refused_clients(replayed).collect()
    assert [(r.zone, r.ip, r.requests, r.refused, r.share) for r in got] == [("api", "a", 2, 1, 0.5)]
    assert rate_limits.leaky_bucket(made(spark, rows).limit(0), limits).count() == 0
    with pytest.raises(ValueError):
        rate_limits.leaky_bucket(made(spark, rows), {"api": (0, 5)})
