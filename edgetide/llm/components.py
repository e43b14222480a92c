"""Connected components by contraction on randomly ordered ids, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.flow import Tables


def components(tables: Tables, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the undirected ``links``; nodes are longs.

    Each round maps a node to the smallest of itself and its neighbours, in an order drawn
    anew each round, and that node to its own choice.  Links of mapped nodes keep the parts
    connected, and a constant share of the nodes goes each round, for chains and stars
    alike.  Nothing but link counts comes to the driver.
    """
    edges = tables.stage(links.filter(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    labels = tables.stage(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
                          .withColumn("label", F.col("node")), "labels")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.select(F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.col("v").alias("near")),
            F.struct(F.col("v").alias("node"), F.col("u").alias("near")))).alias("e")).select("e.*")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
        near = tables.stage(both.groupBy("node").agg(F.min(rank("near")).alias("m"))
                            .select("node", F.least("m", rank("node"))["id"].alias("to")), "near")
        jump = tables.stage(near.alias("p").join(
            near.select(F.col("node").alias("to"), F.col("to").alias("next")), "to")
            .select("node", F.col("next").alias("to")), "jump")
        smaller = edges.join(jump.select(F.col("node").alias("u"), F.col("to").alias("x")), "u") \
            .join(jump.select(F.col("node").alias("v"), F.col("to").alias("y")), "v") \
            .filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        fewer = tables.stage(smaller.distinct(), "edges")
        mapped = tables.stage(labels.join(
            jump.select(F.col("node").alias("label"), "to"), "label", "left")
            .select("node", F.coalesce("to", "label").alias("label")), "labels")
        tables.drop(edges, labels, near, jump)
        edges, labels = fewer, mapped
    tables.drop(edges)
    return labels
