"""Five-stage corpus pipeline over ``documents``: each stage works on all that the one before kept.

language ID -> n-gram Jaccard join -> benchmark decontamination -> mixing -> sharding
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm import decontaminate, flow, language, mixing, ngram_join, sharding
from edgetide.llm.queries import SHARDS, remainder

#: Share of a document's words inside benchmark windows from which it is dropped: any at all.
LEAST_HIT = 1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter go."""
    model = language.train(docs, F.coalesce(remainder(4) == 2, F.lit(False)))
    added = [flow.fresh(c, docs.columns) for c in ("lang_pred", "score")]
    named = language.identify(docs, model, docs.columns, tuple(added))
    return named.filter(F.col(added[0]) != "und").drop(*added)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    tables = flow.Tables(spark)
    hits = decontaminate.decontaminate(docs, flow.read(spark, sf_dir, "benchmark")).filter(
        F.col("n_hit") >= LEAST_HIT).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"))
    hits = tables.stage(hits.distinct(), "contaminated")
    return decontaminate.rows_without(docs, hits, tables)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, written shard by shard in each shard's order."""
    return mixing.shuffled_rows(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot."""
    return sharding.shard_rows(docs, sharding.document_order(), SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", to_target_weights),
    ("sharding", into_shards),
]

#: Language ID and the mix's hash order have no SQL; tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    tables, docs = flow.Tables(spark), flow.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = tables.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if id(docs) in tables.paths:
            tables.drop(docs)
        docs = after
    return docs
