"""The edge's request limit replayed over a log: one leaky bucket per client and zone.

A bucket drains at ``rate`` requests a second and holds ``burst`` requests beyond the one just
served.  A request that would overfill it is refused and leaves it as it is, so the level after
a run of requests depends on each of them in order.  For one client that is a sequential scan,
and one client may hold a third of a log:

* requests of one client and millisecond are counted first, before the shuffle; which of them
  come first makes no difference to the numbers;
* the counts are cut into range blocks, and a block turns the level it is entered with into the
  level it is left with.  In most blocks some client starts anew (or was quiet for as long as a
  full bucket takes to drain), so the exit does not depend on the entry.  Only in blocks filled
  by one busy client is the exit worked out for every possible entry;
* the blocks' functions are chained, one row per block, and each block is replayed from the
  level that is then known.

Levels are kept in thousandths of a request, so milliseconds and whole rates need no fractions.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgetide.functions import paths
from edgetide.operators.ordered import BLOCK, SLOT, order_blocks
from edgetide.staging import stage

ONE = 1000             # a request, in thousandths
EMPTY = -ONE           # a bucket that takes a request without rising above 0
NUMBERS = [BLOCK, SLOT, "_gap", "requests", "_rate", "_burst"]
EXITS = f"{BLOCK} int, _rate long, _burst long, _exits array<long>"
ENTRIES = f"{BLOCK} int, _entry long"


def _in_order(table: pa.Table) -> list[np.ndarray]:
    """Slots, gaps, counts, rates and bursts by slot; gap -1 where a bucket is new."""
    gap = table.column("_gap").fill_null(-1)
    columns = [table.column(SLOT), gap, *[table.column(n) for n in ("requests", "_rate", "_burst")]]
    slot, *others = [c.to_numpy().astype(np.int64) for c in columns]
    order = np.argsort(slot)
    return [c[order] for c in (slot, *others)]


def _replay(level: int, gap, count, rate, burst) -> tuple[list[int], list[int]]:
    """Requests accepted and the level after each row."""
    accepted, levels = [], []
    for g, n, r, b in zip(gap.tolist(), count.tolist(), rate.tolist(), burst.tolist()):
        level = EMPTY if g < 0 else max(EMPTY, level - r * g)
        ok = min(n, (b - level) // ONE)
        level += ONE * ok
        accepted.append(ok)
        levels.append(level)
    return accepted, levels


def lattice(rate: int, burst: int) -> np.ndarray:
    """Every level a bucket can have: steps that both a request and a millisecond are made of."""
    return np.arange(EMPTY, burst + 1, gcd(rate, ONE), dtype=np.int64)


def exits_of(gap, count, rate, burst) -> np.ndarray:
    """The level after the rows: one number, or one for each level of ``lattice`` before them.

    Different entries soon lead to the same level; those that met are carried as one.
    """
    anew = np.flatnonzero((gap < 0) | (gap * rate >= burst + ONE))
    if len(anew):
        at = anew[-1]
        gap = gap[at:].copy()
        gap[0] = -1
        return np.array(_replay(EMPTY, gap, count[at:], rate[at:], burst[at:])[1][-1:], np.int64)
    r, b = int(rate[0]), int(burst[0])
    levels = lattice(r, b)
    where = np.arange(len(levels))
    for k, (g, n) in enumerate(zip(gap.tolist(), count.tolist())):
        if len(levels) == 1:
            rest = _replay(int(levels[0]), gap[k:], count[k:], rate[k:], burst[k:])[1]
            return np.array(rest[-1:], np.int64)
        levels = np.maximum(EMPTY, levels - r * g)
        levels = levels + ONE * np.minimum(n, (b - levels) // ONE)
        if k % 16 == 15:
            levels, back = np.unique(levels, return_inverse=True)
            where = back[where]
    return levels[where]


def _block_exits(table: pa.Table) -> pa.Table:
    _, gap, count, rate, burst = _in_order(table)
    exits = exits_of(gap, count, rate, burst)
    return pa.table({BLOCK: table.column(BLOCK)[:1].cast(pa.int32()), "_rate": pa.array(rate[-1:]),
                     "_burst": pa.array(burst[-1:]), "_exits": pa.array([exits.tolist()], pa.list_(pa.int64()))})


def _chained(table: pa.Table) -> pa.Table:
    """The level each block of a chain leaves to the next one; the chain's first has one exit."""
    level, entries = EMPTY, []
    for _, rate, exits, after in sorted(zip(*[table.column(n).to_pylist() for n in (BLOCK, "_rate", "_exits", "_next")])):
        level = exits[0] if len(exits) == 1 else exits[(level - EMPTY) // gcd(rate, ONE)]
        entries.append((after, level))
    blocks, levels = zip(*entries)
    return pa.table({BLOCK: pa.array(blocks, pa.int32()), "_entry": pa.array(levels, pa.int64())})


def _replayed(schema: pa.Schema) -> Callable:
    def replay(table: pa.Table) -> pa.Table:
        slot, gap, count, rate, burst = _in_order(table)
        entry = table.column("_entry")[0].as_py()
        accepted, levels = _replay(EMPTY if entry is None else entry, gap, count, rate, burst)
        return pa.table([table.column(BLOCK)[0:1].take(np.zeros(len(slot), np.int64)), pa.array(slot),
                         pa.array(accepted, pa.int64()), pa.array(levels, pa.int64())], schema=schema)
    return replay


def leaky_bucket(accesses: DataFrame, limits: dict[str, tuple[int, int]], zone: str = "zone",
                 client: str = "ip", ts: str = "ts", blocks: int | None = None) -> DataFrame:
    """What a limit of (requests a second, burst) per zone does to each client's requests.

    One row per zone, client and millisecond ``instant`` with requests: how many were accepted (the
    first ones) and refused, and the ``level`` after them in thousandths of a request.  Zones
    without a limit, and rows without a client, zone or time, are not limited and left out.
    Rates and bursts are whole numbers, rates above 0.
    """
    if any(rate < 1 or burst < 0 for rate, burst in limits.values()):
        raise ValueError("rates must be above 0, bursts 0 or more")
    counts = (accesses.filter(F.col(zone).isin(list(limits)) & F.col(client).isNotNull() & F.col(ts).isNotNull())
              .groupBy(F.col(zone).alias("zone"), F.col(client).alias("client"), paths.epoch_millis(F.col(ts)).alias("_ms"))
              .agg(F.count("*").alias("requests")))
    cut = order_blocks(counts, ["zone", "client", "_ms"], blocks, "rates")
    here = F.struct("zone", "client", "_ms")
    lasts = cut.groupBy(BLOCK).agg(F.max_by(here, SLOT).alias("_last"))
    # one row per block, here and below
    lasts = lasts.select(BLOCK, F.lag("_last").over(Window.orderBy(BLOCK)).alias("_carried"))
    before = F.coalesce(F.lag(here).over(Window.partitionBy(BLOCK).orderBy(SLOT)), F.col("_carried"))
    same = (before["zone"] == F.col("zone")) & (before["client"] == F.col("client"))
    rows = stage(cut.join(F.broadcast(lasts), BLOCK).withColumn("_gap", F.when(same, F.col("_ms") - before["_ms"]))
                 .withColumn("_rate", paths.one_of(F.col("zone"), {z: r for z, (r, _) in limits.items()}).cast("long"))
                 .withColumn("_burst", paths.one_of(F.col("zone"), {z: b * ONE for z, (_, b) in limits.items()})
                             .cast("long")).drop("_carried"), "gaps")
    numbers = rows.select(*NUMBERS)
    exits = stage(numbers.groupBy(BLOCK).applyInArrow(_block_exits, EXITS), "exits")
    by_block = Window.orderBy(BLOCK)
    chains = exits.withColumns({"_chain": F.sum((F.size("_exits") == 1).cast("int")).over(by_block),
                                "_next": F.lead(BLOCK).over(by_block)})
    entries = stage(chains.groupBy("_chain").applyInArrow(_chained, ENTRIES).filter(F.col(BLOCK).isNotNull()),
                    "entries")
    schema = pa.schema([(BLOCK, pa.int32()), (SLOT, pa.int64()), ("accepted", pa.int64()), ("level", pa.int64())])
    done = (numbers.join(F.broadcast(entries), BLOCK, "left").groupBy(BLOCK)
            .applyInArrow(_replayed(schema), f"{BLOCK} int, {SLOT} long, accepted long, level long"))
    return rows.join(done, [BLOCK, SLOT]).select(
        "zone", F.col("client").alias(client), paths.at_millis(F.col("_ms")).alias("instant"), "requests", "accepted",
        (F.col("requests") - F.col("accepted")).alias("refused"), "level")


def refused_clients(replayed: DataFrame, client: str = "ip") -> DataFrame:
    """Clients with refused requests: how many, over which time, and the share of their requests."""
    refused = F.col("refused") > 0
    return (replayed.groupBy("zone", client)
            .agg(F.sum("requests").alias("requests"), F.sum("refused").alias("refused"),
                 F.min(F.when(refused, F.col("instant"))).alias("first_refused"),
                 F.max(F.when(refused, F.col("instant"))).alias("last_refused"))
            .filter(F.col("refused") > 0)
            .withColumn("share", F.col("refused") / F.col("requests")))
