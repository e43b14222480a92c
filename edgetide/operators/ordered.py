"""Order-dependent steps that no single task has to do alone.

A window without a partition key, or with one key that holds most rows, puts those
rows in one task.  Everything here goes through *range blocks* instead: one range
shuffle on a unique order, sorted inside each block and written once.  A row knows
its block and its place in the block, so ranks, positions and running sums need
only small totals per block (or per block and key) on top.

* ``order_blocks``   the range blocks themselves
* ``with_position``  0-based position in the whole order
* ``with_rank``      1-based rank inside a key
* ``running_sum``    cumulative sum inside a key
* ``next_marked``    value of the next marked row in the order (an as-of lookup)
* ``exact_median``   exact median through counts per distinct value
* ``group_total``    a total per key attached to every row, for keys of any size
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgetide.staging import stage

BLOCK = "_block"
SLOT = "_slot"


def _sort_columns(order: Sequence) -> list[Column]:
    return [F.col(o).asc() if isinstance(o, str) else o for o in order]


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL, so that rows with a NULL key aren't lost."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    condition = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"_same_{k}"])
        condition = one if condition is None else condition & one
    joined = left.join(renamed, condition, how)
    if how == "full_outer":
        joined = joined.withColumns({k: F.coalesce(left[k], renamed[f"_same_{k}"]) for k in keys})
    return joined if how == "left_anti" else joined.drop(*[f"_same_{k}" for k in keys])


def order_blocks(df: DataFrame, order: Sequence, blocks: int | None = None,
                 label: str = "blocks") -> DataFrame:
    """``df`` in contiguous blocks of the given order, with ``_block`` and ``_slot``.

    ``order`` must be unique per row, so that equal keys never overfill a block and a
    retried task numbers its rows the same way.  Without ``blocks`` the number comes
    from ``spark.sql.shuffle.partitions``, and adaptive execution merges small
    neighbours.
    """
    columns = _sort_columns(order)
    ranged = (df.repartitionByRange(blocks, *columns) if blocks
              else df.repartitionByRange(*columns))
    # the id is (task number << 33) + row number in the task; rows are already sorted
    numbered = ranged.sortWithinPartitions(*columns).withColumn(
        SLOT, F.monotonically_increasing_id())
    staged = stage(numbered, label)
    return staged.withColumns({
        BLOCK: F.shiftright(SLOT, 33).cast("int"),
        SLOT: F.col(SLOT).bitwiseAND(F.lit((1 << 33) - 1)),
    })


def offsets(blocks: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Totals of all earlier blocks, per key and block: ``before_<name>`` columns.

    At most one row per block and key present in it.  Without keys the window runs
    over one row per block.
    """
    totals = blocks.groupBy(*keys, BLOCK).agg(
        *[F.sum(c).alias(name) for name, c in sums.items()],
        F.min(SLOT).alias("first_slot"))
    earlier = (Window.partitionBy(*keys).orderBy(BLOCK)
               .rowsBetween(Window.unboundedPreceding, -1))
    befores = totals.select(
        *keys, BLOCK, "first_slot",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"before_{name}")
          for name in sums])
    return stage(befores, "offsets")


def with_position(df: DataFrame, order: Sequence, name: str = "pos",
                  blocks: int | None = None, keep_block: bool = False) -> DataFrame:
    """0-based position in the whole order. One range shuffle, no window over rows."""
    cut = order_blocks(df, order, blocks)
    before = offsets(cut, [], n=F.lit(1))
    # one row per block, so never more rows than shuffle partitions
    numbered = (cut.join(F.broadcast(before.select(BLOCK, "before_n")), BLOCK)
                .withColumn(name, F.col("before_n") + F.col(SLOT)).drop(SLOT, "before_n"))
    return numbered if keep_block else numbered.drop(BLOCK)


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rank",
              blocks: int | None = None) -> DataFrame:
    """1-based row number inside ``keys``; a key may span any number of blocks."""
    cut = order_blocks(df, [*keys, *order], blocks)
    before = offsets(cut, keys, n=F.lit(1))
    return (join_same(cut, before, [*keys, BLOCK])
            .withColumn(name, F.col(SLOT) - F.col("first_slot") + F.col("before_n") + 1)
            .drop(BLOCK, SLOT, "first_slot", "before_n"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value: str,
                name: str, blocks: int | None = None) -> DataFrame:
    """Sum of ``value`` over this and all earlier rows of the key."""
    cut = order_blocks(df, [*keys, *order], blocks)
    before = offsets(cut, keys, total=F.col(value)).drop("first_slot")
    inside = (Window.partitionBy(*keys, BLOCK).orderBy(SLOT)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (join_same(cut, before, [*keys, BLOCK])
            .withColumn(name, F.sum(value).over(inside) + F.col("before_total"))
            .drop(BLOCK, SLOT, "before_total"))


def next_marked(df: DataFrame, order: Sequence, value: str, name: str,
                blocks: int | None = None) -> DataFrame:
    """``value`` of this or the first later row where it is not NULL."""
    cut = order_blocks(df, order, blocks)
    firsts = cut.groupBy(BLOCK).agg(
        F.min_by(value, F.when(F.col(value).isNotNull(), F.col(SLOT))).alias("first"))
    # backwards frames that start at the first row are computed in one pass
    later = (Window.orderBy(F.desc(BLOCK))
             .rowsBetween(Window.unboundedPreceding, -1))
    carried = stage(firsts.select(
        BLOCK, F.last("first", ignorenulls=True).over(later).alias("carried")), "carried")
    ahead = (Window.partitionBy(BLOCK).orderBy(F.desc(SLOT))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (cut.withColumn(name, F.last(value, ignorenulls=True).over(ahead))
            .join(F.broadcast(carried), BLOCK)  # one row per block
            .withColumn(name, F.coalesce(name, "carried"))
            .drop(BLOCK, SLOT, "carried"))


def value_counts_in_order(df: DataFrame, value: str, blocks: int | None = None,
                          **measures: Column) -> DataFrame:
    """One row per distinct value with its measures and their sums over smaller values.

    Values are pre-aggregated, so a value that fills a third of the rows is one row
    here.  Adds ``below_<measure>`` columns.
    """
    counts = df.groupBy(value).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    cut = order_blocks(counts, [value], blocks, "values")
    before = offsets(cut, [], **{n: F.col(n) for n in measures}).drop("first_slot")
    inside = (Window.partitionBy(BLOCK).orderBy(SLOT)
              .rowsBetween(Window.unboundedPreceding, -1))
    return cut.join(F.broadcast(before), BLOCK).select(  # one row per block
        value, *measures,
        *[(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"before_{n}"))
          .alias(f"below_{n}") for n in measures])


def exact_median(df: DataFrame, value: str, name: str = "median",
                 blocks: int | None = None) -> DataFrame:
    """One row: the exact median of the non-NULL values (NULL when there are none)."""
    ordered = value_counts_in_order(df.filter(F.col(value).isNotNull()).select(value),
                                    value, blocks, n=F.lit(1))
    total = ordered.select(F.sum("n")).scalar()
    covers = [(F.col("below_n") <= k) & (k < F.col("below_n") + F.col("n"))
              for k in (F.floor((total - 1) / 2), F.floor(total / 2))]
    picked = [F.max(F.when(c, F.col(value))) for c in covers]
    return ordered.agg(((picked[0] + picked[1]) / 2.0).alias(name))


def group_total(df: DataFrame, key: str, row_key: str, name: str, value: Column | None = None
                ) -> DataFrame:
    """Attach the number of rows (or the sum of ``value``) of each key to its rows.

    Keys with more rows than an even partition would hold are hot; there are fewer of
    them than partitions, so their totals are broadcast and their rows are spread by
    ``row_key`` instead of by key.  All other keys meet their totals in a shuffle join,
    or a broadcast one when the staged totals are small.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = stage(df.groupBy(key).agg(
        F.count("*").alias("_n"),
        (F.count("*") if value is None else F.sum(value)).alias("_total")), "totals")
    rows = totals.select(F.sum("_n")).scalar()
    hot = totals.filter(F.col("_n") > rows / partitions).select(key, F.col("_total").alias("_hot"))
    spread = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(row_key), F.lit(partitions)))
    marked = df.join(F.broadcast(hot), key, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(spread))
    cold = totals.select(F.col(key).cast("string").alias("_key"), F.col("_total").alias("_cold"))
    return (marked.join(cold, "_key", "left")
            .withColumn(name, F.coalesce("_hot", "_cold")).drop("_key", "_hot", "_cold"))
