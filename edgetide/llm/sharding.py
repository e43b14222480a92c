"""Shard and slot of every row by a Feistel permutation of its global row number.

Rows are numbered 0..n-1 in a fixed order.  A keyed permutation of these numbers, split by the
shard count, gives ``shard = p mod shards`` and ``slot = p div shards``: the law is ``rows``,
counts differ by one at most and slots have no gap.  Anyone can compute the place of a row
number, or walk the permutation back, without the data.

The network works on pairs (left, right) of an ``a`` by ``b`` grid with a * b >= n, alternating
the moduli, so hardly any number falls outside 0..n-1; those that do are walked on along their
cycle until they are back inside.  With a * b - n < a, ``WALK`` steps are enough for sure when
a <= WALK, and else but for a chance of (1 / a) ** WALK; should a row still be outside, the job
fails rather than misplace it.

Rows are numbered by doc_id (nulls first) and text; rows equal in both are alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm import flow
from edgetide.operators.ordered import with_position

ROUNDS = 6
WALK = 64
SEED = 20240607
PRIME = (1 << 31) - 1


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int = SEED) -> list[int]:
    return [(seed * 48271 + 40692 * (k + 1) * (k + 1)) % PRIME for k in range(ROUNDS)]


def mix(half: Column, key: Column) -> Column:
    """Round function: products modulo a prime with shifts in between."""
    x = (half + key) * 48271 % PRIME
    x = x.bitwiseXOR(F.shiftright(x, 13)) * 69621 % PRIME
    return x.bitwiseXOR(F.shiftright(x, 15))


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """One pass through the network: the numbers below a * b onto themselves."""
    a, b = (F.lit(x).cast("long") for x in grid(n))
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])

    def step(s: Column, i: Column) -> Column:
        key = F.element_at(keys, i + 1)
        return F.when(i % 2 == 0, F.struct(((s["l"] + mix(s["r"], key)) % a).alias("l"), s["r"].alias("r"))) \
            .otherwise(F.struct(s["l"].alias("l"), ((s["r"] + mix(s["l"], key)) % b).alias("r")))

    start = F.struct((number % a).alias("l"), F.call_function("div", number, a).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["r"] * a + s["l"])


def walked(once: Column, n: int, seed: int = SEED) -> Column:
    """The first number below ``n`` on the cycle from ``once`` on."""
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once,
                         lambda x, _: F.when(x < n, x).otherwise(permuted(x, n, seed)))
    safe = F.when(inside < n, inside).otherwise(F.raise_error(F.lit("cycle walk left a row outside")).cast("long"))
    return F.when(once < n, once).otherwise(safe)


def shard_rows(rows: DataFrame, order: list[Column], shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` (int, from 0) and ``slot`` (long, from 0 in each shard), which
    take the place of columns called so.

    ``order`` fixes the row numbers; rows it does not tell apart must be alike.  One range
    shuffle; the row count and one offset per block are all that is gathered.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    keys = {f"o{k}": c for k, c in enumerate(order)}
    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"),
                         *[c.alias(name) for name, c in keys.items()])
    numbered = with_position(packed, list(keys), "number")      # nulls first
    n = rows.count()
    placed = numbered.select("row", "number", permuted(F.col("number"), n, seed).alias("once")) \
        .select("row", walked(F.col("once"), n, seed).alias("place"))
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*[F.col("row")[c].alias(c) for c in kept],
                         (F.col("place") % shards).cast("int").alias("shard"),
                         F.call_function("div", F.col("place"), F.lit(shards).cast("long")).alias("slot"))


def document_order() -> list[Column]:
    return [F.col("doc_id").cast("long"), flow.text_key()]
