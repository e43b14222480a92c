"""Mix of sources to target weights by a splitting tree over exact block quotas, without Python.

1. Sources by code point (null last) weigh 5, 2, 1, repeating, and share the words of all rows;
   a source above ``MOST`` times its own words stops there and the rest is shared again.
2. A source's rows are put in a random order (by hash) and cut into ``BLOCKS`` blocks of equal
   words; its quota is its target in whole blocks.
3. The quotas are split among output shards down a binary tree: at each node, one half gets
   exactly its number of blocks, drawn without replacement, so each source's part follows the
   multivariate hypergeometric law and all quotas add up at each level.
4. A source's draws run through its permuted blocks (again from the first when the quota is
   above all of them), each shard taking the next ones: disjoint sets of random blocks.  Rows
   of a shard are put in the order of a hash.

Everything is a function of the rows and the seed, so reruns agree.  A null or empty text has
size 0 and is taken as its block is.  Rows equal in doc_id, text and source are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm import flow
from edgetide.llm.flow import Tables
from edgetide.operators.ordered import running_sum, with_position

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCKS = 1024
SHARDS = 16
SEED = 77


def sizes(text: str = "text") -> Column:
    """Number of words between blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, tables: Tables) -> DataFrame:
    """(source, place, source_size, weight, target) from rows with source and size."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = with_position(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    placed = tables.stage(placed.withColumn("weight", weight.cast("long")), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    # every round shares what the stopped sources leave; sources only ever get stopped
    level, stopped = 0.0, -1
    while True:
        at_most = F.col("weight") * F.lit(level) > F.col("source_size") * MOST
        full, count, weights = placed.agg(
            F.sum(F.when(at_most, F.col("source_size") * MOST).otherwise(0)),
            F.sum(at_most.cast("int")), F.sum(F.when(at_most, 0).otherwise(F.col("weight")))).first()
        if not weights or count == stopped:
            break
        level, stopped = (total - full) / weights, count
    level = F.lit(level)
    capped = F.col("weight") * level > F.col("source_size") * MOST
    return placed.withColumn("target", F.when(capped, (F.col("source_size") * MOST).cast("double"))
                             .otherwise(F.col("weight") * level))


def chance(*of: Column) -> Column:
    """A fixed number in [0, 1) for each combination."""
    return F.shiftrightunsigned(F.xxhash64(*of, F.lit(SEED)), 11).cast("double") / float(1 << 53)


def drawn(counts: Column, n: Column, node: Column) -> Column:
    """How many of ``n`` draws without replacement fall on each source of ``counts``.

    Goes through the blocks of a node once: each is drawn with the chance that the draws left
    have among the blocks left, which makes ``n`` draws exactly.
    """
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c)
    start = F.struct(n.cast("long").alias("draws"), total.alias("blocks"),
                     F.array().cast("array<long>").alias("out"))

    def source(s: Column, c: Column) -> Column:
        inner = F.struct(s["draws"].alias("draws"), s["blocks"].alias("blocks"), F.lit(0).cast("long").alias("hit"))

        def block(t: Column, _: Column) -> Column:
            hit = (chance(node, t["blocks"]) * t["blocks"] < t["draws"]).cast("long")
            return F.struct((t["draws"] - hit).alias("draws"), (t["blocks"] - 1).alias("blocks"),
                            (t["hit"] + hit).alias("hit"))
        steps = F.when(c > 0, F.sequence(F.lit(1).cast("long"), c)).otherwise(F.array().cast("array<long>"))
        return F.aggregate(steps, inner, block, lambda t: F.struct(
            t["draws"].alias("draws"), t["blocks"].alias("blocks"), F.concat(s["out"], F.array(t["hit"])).alias("out")))

    return F.aggregate(counts, start, source, lambda s: s["out"])


def shard_quotas(quotas: DataFrame, tables: Tables, shards: int) -> DataFrame:
    """(place, upto): per source the running number of draws after each shard.

    A node of the tree is one row with a number for each source.
    """
    level = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("q")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("width"), F.transform("q", lambda x: x["place"]).alias("places"),
        F.transform("q", lambda x: x["quota"]).alias("counts"))
    width = shards
    while width > 1:
        left = F.call_function("div", F.col("width") + 1, F.lit(2)).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
        share = F.call_function("div", total * left, F.col("width"))
        split = level.withColumn("left", F.when(F.col("width") > 1, drawn(
            F.col("counts"), share, F.col("lo") * 65536 + F.col("width"))).otherwise(F.col("counts")))
        halves = F.when(F.col("width") > 1, F.array(
            F.struct("lo", left.alias("width"), F.col("left").alias("counts")),
            F.struct((F.col("lo") + left).alias("lo"), (F.col("width") - left).alias("width"),
                     F.zip_with("counts", "left", lambda c, x: c - x).alias("counts")))).otherwise(
            F.array(F.struct("lo", "width", "counts")))
        level = tables.stage(split.select("places", F.explode(halves).alias("h")).select("places", "h.*"), "tree")
        width = (width + 1) // 2
    cells = level.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("places", "counts")).alias("c")) \
        .select("shard", F.col("c.places").alias("place"), F.col("c.counts").alias("n"))
    own = F.array_sort(F.collect_list(F.struct("shard", "n")))
    return cells.groupBy("place").agg(own.alias("cells")).select("place", F.aggregate(
        "cells", F.array().cast("array<long>"),
        lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x["n"]))).alias("upto"))


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, key, source, size, copies, source_size, target, shards, orders) of ``docs``.

    One row per different (doc_id, text, source), ``copies`` of which are in ``docs``;
    ``shards`` has the output shard of each time every one of them is taken, ``orders`` the number by
    which its shard is shuffled.
    """
    tables = Tables(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "source", flow.text_key().alias("key"), sizes().alias("size"))
    rows = tables.stage(rows.groupBy("doc_id", "key", "source").agg(
        F.max("size").alias("size"), F.count("*").alias("copies")), "rows")
    words = F.col("size") * F.col("copies")
    sources = tables.stage(source_targets(rows.select("source", words.alias("size")), tables), "targets")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * BLOCKS)) \
        .otherwise(0).cast("long")
    quotas = sources.select("place", quota.alias("quota"))
    upto = tables.stage(shard_quotas(quotas, tables, shards), "quotas")

    named = sources.withColumnRenamed("source", "own")
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("own"))).drop("own").withColumns(
        {"words": words, "turn": F.xxhash64("doc_id", "key", F.lit(SEED))})
    summed = running_sum(placed, ["place"], [F.col("turn").asc(), F.col("doc_id").asc(), F.col("key").asc()],
                         "words", "upto_here")
    middle = F.col("upto_here") - F.col("words") / 2
    block = F.when(F.col("source_size") > 0, F.least(
        F.lit(BLOCKS - 1), F.floor(middle * BLOCKS / F.col("source_size")))).otherwise(0).cast("long")
    draws = F.transform(F.filter(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda p: p * BLOCKS + F.col("block") <
                                 F.element_at("upto", -1)), lambda p: p * BLOCKS + F.col("block"))
    return summed.withColumn("block", block).join(upto, "place").select(
        "doc_id", "key", "source", "size", "copies", "source_size", "target",
        F.transform(draws, lambda d: F.size(F.filter("upto", lambda u: u <= d))).alias("shards"),
        F.transform(draws, lambda _, turn: F.xxhash64("doc_id", "key", turn, F.lit(SEED + 1))).alias("orders"))


def mixed_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(row, mix_shard, mix_order): ``docs`` as the mix has them, every row, a struct, as often
    as it is taken, with its output shard and the order by which a shard is shuffled."""
    plan = mix(docs, shards).select(F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"),
                                    F.col("source").alias("p_source"), F.arrays_zip("shards", "orders").alias("takes"))
    joined = flow.packed_rows(docs).join(plan, F.col("doc_id").eqNullSafe(F.col("p_id"))
                                         & (F.col("key") == F.col("p_key"))
                                         & F.col("row.source").eqNullSafe(F.col("p_source")))
    return joined.select("row", F.explode("takes").alias("take")).select(
        "row", F.col("take.shards").alias("mix_shard"), F.col("take.orders").alias("mix_order"))


def shuffled_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mixed rows alone, each shard shuffled by its order.

    A shard is cut by ranges of its order, so that the session's partitions and not the shards bound
    what a task holds.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = max(1, -(-partitions // shards))
    piece = F.floor((F.col("mix_order").cast("double") / 2.0 ** 64 + 0.5) * cuts)
    return mixed_rows(docs, shards).withColumn("piece", piece).repartition("mix_shard", "piece") \
        .sortWithinPartitions("mix_shard", "piece", "mix_order").select("row.*")
