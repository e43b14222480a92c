"""Features, labels and exact LRU state over the ordered access trace.

A trace is cut into range blocks by (time, key).  History and look-ahead of one
object are windows over (object, block), so an object with a third of all accesses
is spread over all blocks; what an object carries from one block to another is a
small summary per (object, block).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths
from edgetide.operators.ordered import BLOCK, join_same, with_position
from edgetide.staging import stage


def positioned(accesses: DataFrame, key: str, ts: str = "ts", blocks: int | None = None, by=()
               ) -> DataFrame:
    """The trace in time order with ``pos`` (0-based) and its block; with ``by``, one trace after another."""
    return with_position(accesses, [*by, ts, key], "pos", blocks, keep_block=True)


def history(trace: DataFrame, by=("file_id",), ts: str = "ts",
            carry: tuple[str, ...] = (), state: DataFrame | None = None) -> DataFrame:
    """Running count and age since the object's previous access (first: 0).

    Adds access_count, age_since_last_access, age_hours, access_rate, recency_score and
    ``prev_<column>`` for each column in ``carry`` and for ``ts``.  ``state`` (see
    ``object_state``) is what earlier parts of the trace left behind; it meets the
    summaries, not the rows, so a hot object joins once per block.
    """
    by = list(by)
    columns = [ts, *carry]
    # one fixed-width maximum per column keeps this a hash aggregate; a struct would not
    summary = trace.groupBy(*by, BLOCK).agg(
        F.count("*").alias("_n"), *[F.max_by(c, "pos").alias(f"_last_{c}") for c in columns]
    ).withColumn("_last", F.struct(*[F.col(f"_last_{c}").alias(c) for c in columns]))
    by_block = Window.partitionBy(*by).orderBy(BLOCK)
    carried = summary.select(
        *by, BLOCK, F.coalesce(F.sum("_n").over(
            by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_seen"),
        F.lag("_last").over(by_block).alias("_carried"))
    if state is not None:
        carried = join_same(carried, state, by, "left").select(
            *by, BLOCK, (F.col("_seen") + F.coalesce("state_count", F.lit(0))).alias("_seen"),
            F.coalesce("_carried", "state_last").alias("_carried"))
    inside = Window.partitionBy(*by, BLOCK).orderBy("pos")
    numbered = trace.withColumns({"_rn": F.row_number().over(inside),
                                  "_prev": F.lag(F.struct(*columns)).over(inside)})
    rows = (join_same(numbered, carried, [*by, BLOCK])
            .withColumns({"access_count": F.col("_rn") + F.col("_seen"),
                          "_prev": F.coalesce("_prev", "_carried")}))
    age = F.coalesce(paths.seconds_between(F.col(f"_prev.{ts}"), F.col(ts)).cast("double"),
                     F.lit(0.0))
    rows = rows.withColumn("age_since_last_access", age).withColumn(
        "age_hours", F.col("age_since_last_access") / 3600.0)
    return rows.withColumns({
        "access_rate": F.when(F.col("age_hours") > 0, F.col("access_count") / F.col("age_hours"))
        .otherwise(F.col("access_count").cast("double")),
        "recency_score": 1.0 / (1.0 + F.col("age_since_last_access") / 3600.0),
        **{f"prev_{c}": F.col(f"_prev.{c}") for c in columns},
    }).drop("_rn", "_prev", "_seen", "_carried")


def object_state(trace: DataFrame, by=("file_id",), ts: str = "ts",
                 carry: tuple[str, ...] = (), state: DataFrame | None = None, changed: bool = False) -> DataFrame:
    """Count and last access per object, added to an earlier ``state``; the later access stays.

    With ``changed``, only the objects of this trace.
    """
    by = list(by)
    columns = [ts, *carry]
    part = trace.groupBy(*by).agg(
        F.count("*").alias("state_count"),
        *[F.max_by(c, "pos").alias(f"_last_{c}") for c in columns]
    ).select(*by, "state_count",
             F.struct(*[F.col(f"_last_{c}").alias(c) for c in columns]).alias("state_last"))
    if state is None:
        return part
    old = state.select(*by, F.col("state_count").alias("_count"), F.col("state_last").alias("_last"))
    late = F.col(f"state_last.{ts}") < F.col(f"_last.{ts}")
    return join_same(part, old, by, "left" if changed else "full_outer").select(
        *by, (F.coalesce("state_count", F.lit(0)) + F.coalesce("_count", F.lit(0)))
        .alias("state_count"),
        F.when(late, F.col("_last")).otherwise(F.coalesce("state_last", "_last")).alias("state_last"))


def look_ahead(trace: DataFrame, window: int = fixed.LOOK_AHEAD,
               future: int = fixed.FUTURE_ACCESSES, base: DataFrame | None = None) -> DataFrame:
    """Labels from the next accesses of the same object.

    Adds next_access_distance, future_reuse_prob and will_be_accessed_in_n.  When
    ``trace`` already carries computed columns, ``base`` is the plain positioned trace,
    from which the summaries are read.
    """
    base = trace if base is None else base
    inside = Window.partitionBy("file_id", BLOCK).orderBy("pos")
    # the row-number filter is applied before the shuffle: few rows per object and block
    heads = (base.select("file_id", BLOCK, "pos")
             .withColumn("_rn", F.row_number().over(inside)).filter(F.col("_rn") <= future)
             .groupBy("file_id", BLOCK).agg(F.sort_array(F.collect_list("pos")).alias("_head")))
    # every later block with the object has at least one access of it
    later = Window.partitionBy("file_id").orderBy(BLOCK).rowsBetween(1, future)
    carried = heads.select("file_id", BLOCK,
                           F.slice(F.flatten(F.collect_list("_head").over(later)), 1, future)
                           .alias("_later"))
    # plain columns, as functions over arrays are not compiled: the k-th next access is in the
    # block or, when that holds only n of them, the (k - n)-th of the later ones
    ahead = [f"_ahead{k}" for k in range(1, future + 1)]
    rows = (trace.withColumns({a: F.lead("pos", k).over(inside) for k, a in enumerate(ahead, 1)})
            .join(carried, ["file_id", BLOCK])
            .withColumn("_n", sum((F.col(a).isNotNull().cast("int") for a in ahead), F.lit(0))))
    rows = rows.withColumns({
        a: F.coalesce(a, F.when(F.col("_n") < k, F.get("_later", F.lit(k - 1) - F.col("_n")))) - F.col("pos")
        for k, a in enumerate(ahead, 1)})
    weight = sum((F.when(F.col(a) <= window, 1.0 / F.col(a)).otherwise(F.lit(0.0)) for a in ahead), F.lit(0.0))
    next_one = F.col(ahead[0])
    return rows.withColumns({
        "next_access_distance": F.coalesce(
            next_one, F.lit(window * fixed.NO_REUSE_FACTOR)).cast("bigint"),
        "future_reuse_prob": F.least(weight, F.lit(1.0)),
        "will_be_accessed_in_n": F.coalesce((next_one <= window).cast("int"), F.lit(0)),
    }).drop(*ahead, "_later", "_n")


# --- exact LRU -------------------------------------------------------------------

def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each i, how many j < i have values[j] < values[i]; n log n, no Python loop."""
    n = len(values)
    counts = np.zeros(n, dtype=np.int64)
    if n < 2:
        return counts
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    span = int(ranks.max()) + 1
    where = np.arange(n)
    width = 1
    while width < n:
        pair = where // (2 * width)
        left = (where // width) % 2 == 0
        # left halves sorted by (pair, rank); each right element looks up its own pair
        keys = np.sort((pair * span + ranks)[left])
        right = np.flatnonzero(~left)
        starts = np.searchsorted(keys, pair[right] * span, side="left")
        found = np.searchsorted(keys, pair[right] * span + ranks[right], side="left")
        counts[right] += found - starts
        width *= 2
    return counts


def _previous(trace: DataFrame, keys: list[str]) -> DataFrame:
    """``_prev`` and ``_prev_block``: place and block of the object's previous access, -1 without one."""
    summary = trace.groupBy(*keys, BLOCK).agg(F.max("pos").alias("_last"))
    before = F.lag(F.struct("_last", BLOCK)).over(Window.partitionBy(*keys).orderBy(BLOCK))
    carried = summary.select(*keys, BLOCK, before.alias("_carried"))
    inside = F.lag("pos").over(Window.partitionBy(*keys, BLOCK).orderBy("pos"))
    rows = join_same(trace.withColumn("_inside", inside), carried, [*keys, BLOCK])
    return rows.withColumns({
        "_prev": F.coalesce("_inside", "_carried._last", F.lit(-1)).cast("long"),
        "_prev_block": F.when(F.col("_inside").isNotNull(), F.col(BLOCK))
        .otherwise(F.coalesce(F.col(f"_carried.{BLOCK}"), F.lit(-1)))}).drop("_inside", "_carried")


def _earlier_cells(rows: DataFrame) -> DataFrame:
    """(_prev_block, _block, _cells): rows in strictly earlier blocks of both kinds, for each cell in use.

    The grid has a cell per pair of blocks, whatever the trace's length; its two running sums are
    windows over one row or column of it.
    """
    cells = stage(rows.groupBy(BLOCK, "_prev_block").agg(F.count("*").alias("_n")), "cells")
    last = cells.agg(F.coalesce(F.max(BLOCK), F.lit(-1))).first()[0]
    grid = rows.sparkSession.range(last + 1).select(
        F.col("id").cast("int").alias(BLOCK), F.explode(F.sequence(F.lit(-1), F.lit(last))).alias("_prev_block"))
    before = lambda key, order: (Window.partitionBy(key).orderBy(order)
                                 .rowsBetween(Window.unboundedPreceding, -1))
    return (grid.join(cells, [BLOCK, "_prev_block"], "left")
            .withColumn("_above", F.coalesce(F.sum("_n").over(before("_prev_block", BLOCK)), F.lit(0)))
            .withColumn("_cells", F.coalesce(F.sum("_above").over(before(BLOCK, "_prev_block")), F.lit(0)))
            .filter(F.col("_n").isNotNull() & (F.col("_prev_block") >= 0)).select("_prev_block", BLOCK, "_cells"))


def _longs(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64) for n in names]


def _same_block(table: pa.Table) -> pa.Table:
    """Rows of one block: earlier ones whose previous access lies in an earlier block."""
    pos, prev_block = _longs(table, "pos", "_prev_block")
    order = np.argsort(pos)
    counts = np.empty(len(order), np.int64)
    counts[order] = smaller_before(prev_block[order])
    return table.append_column("_inside", pa.array(counts))


def _same_previous(rows: pa.Table, cells: pa.Table) -> pa.Table:
    """Rows with their previous access in one block: the distance, all three parts added up."""
    pos, prev, block, inside = _longs(rows, "pos", "_prev", BLOCK, "_inside")
    order = np.argsort(prev)
    counts = np.empty(len(order), np.int64)
    counts[order] = smaller_before(pos[order])
    known, value = _longs(cells, BLOCK, "_cells")
    sort = np.argsort(known)
    counts += inside + value[sort][np.searchsorted(known[sort], block)]
    # up to and including the previous access every row counts, and none is strictly between
    return rows.append_column("distance", pa.array(counts - (prev + 1)))


def stack_distances(trace: DataFrame, by=(), name: str = "file_id") -> DataFrame:
    """``distance``: distinct other objects since the object's previous access (NULL on its first), and
    ``seen``: distinct objects before the row.  Each trace of ``by`` is a cache of its own.

    An LRU cache of C objects has a hit where ``distance < C``, so one table serves every capacity.

    The distance is the number of earlier rows with an earlier previous access, less those up to the
    own previous one.  It is counted in three parts: rows in earlier blocks with the previous access
    in an earlier block (totals per pair of blocks), rows of the same block, and rows with the
    previous access in the same block.  No group is larger than a block: a place is the
    previous one of at most one row.  Python gets the numbers; other columns pass through as Arrow buffers.
    """
    rows = stage(_previous(trace, [*by, name]), "previous")
    first = (F.col("_prev") < 0).cast("long")
    totals = rows.groupBy(*by, BLOCK).agg(F.sum(first).alias("_firsts"))
    earlier = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    seen = totals.select(*by, BLOCK, F.coalesce(F.sum("_firsts").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    counted = (join_same(rows.withColumn("_own", F.coalesce(F.sum(first).over(within), F.lit(0))),
                         stage(seen, "seen"), [*by, BLOCK])
               .withColumn("seen", F.col("_own") + F.col("_before")).drop("_own", "_before"))
    schema = StructType(counted.schema.fields + [StructField("_inside", LongType())])
    counted = stage(counted.groupBy(BLOCK).applyInArrow(_same_block, schema), "same-block")
    schema = StructType(counted.schema.fields + [StructField("distance", LongType())])
    again = (counted.filter(F.col("_prev") >= 0).groupBy("_prev_block")
             .cogroup(_earlier_cells(rows).groupBy("_prev_block")).applyInArrow(_same_previous, schema))
    new = counted.filter(F.col("_prev") < 0).withColumn("distance", F.lit(None).cast("long"))
    return again.unionByName(new).drop("_prev", "_prev_block", "_inside")


def lru_columns(rows: DataFrame, capacity: int = fixed.CACHE_OBJECTS) -> DataFrame:
    """hit and stack_distance_approx for a cache of ``capacity`` objects, from ``stack_distances``.

    On a hit the stack position counts from the least recent end, starting at 1; on a
    miss it is the occupancy plus 1.
    """
    occupied, hit = F.least("seen", F.lit(capacity)), F.coalesce(F.col("distance") < capacity, F.lit(False))
    return rows.withColumns({"hit": hit.cast("int"), "stack_distance_approx": F.when(
        hit, occupied - F.col("distance")).otherwise(occupied + 1).cast("long")})


def with_lru(trace: DataFrame, capacity: int = fixed.CACHE_OBJECTS, by=()) -> DataFrame:
    """Add hit and stack_distance_approx."""
    return lru_columns(stack_distances(trace, by), capacity).drop("distance", "seen")


def training_statistics(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count("*").alias("total_records"),
        F.count_distinct("file_id").alias("unique_files"),
        F.avg("hit").alias("hit_rate"),
        F.avg("next_access_distance").alias("avg_access_distance"),
        F.avg("future_reuse_prob").alias("avg_reuse_prob"),
        F.avg("stack_distance_approx").alias("avg_stack_distance"))
