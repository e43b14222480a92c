"""One query per operator over its whole table, and the SQL of those that SQL can express.

``contract`` functions derive the columns a query returns from an operator's own output; they
take DataFrames, so tests give them small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm import (codebooks, decontaminate, flow, hard_negatives, language, licenses, line_dedup, mixing,
                          ngram_join, oracle, personal_data, quality, sharding, suffix_dedup, topk)
from edgetide.llm.flow import read

SHARDS = 24


def shard_documents(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select(F.col("doc_id").cast("long"), size.alias("size"), flow.text_key().alias("key"),
                       F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    return sharding.shard_rows(rows, [F.col("doc_id"), F.col("key")], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    ids = F.array_join("item_ids", ",")
    return decontaminate.decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def repeated_lines(docs: DataFrame) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def remainder(n: int):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % n


def languages(docs: DataFrame) -> DataFrame:
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    model = language.train(docs, held)
    return language.identify(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    model = quality.train(docs, labels, held)
    return quality.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


def neighbours(vectors: DataFrame) -> DataFrame:
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def mixture(docs: DataFrame) -> DataFrame:
    plan = mixing.mix(docs)
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.size("shards")).alias("taken"), F.array_join("shards", ",").alias("shards"),
        F.array_join("orders", ",").alias("orders"),
                       F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"),
        (removed > 0).alias("has_repeats"))


def licence_scan(docs: DataFrame) -> DataFrame:
    return licenses.licences(docs).select(
        "doc_id", F.size("licences").cast("long").alias("n_licences"),
        F.array_join("licences", ",").alias("licences"), "best_licence",
        F.round("best_dice", 6).alias("best_dice"))


def mined_negatives(vectors: DataFrame) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", moved.alias("label")),
                               F.col("vec_id") % 100 == 0)


def vector_codes(vectors: DataFrame) -> DataFrame:
    codes, books = codebooks.compress(vectors)
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, codebooks.digest(book)).otherwise(digest)
    return codebooks.with_label_errors(codes).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def personal(docs: DataFrame) -> DataFrame:
    counts = [personal_data.count(F.col("base"), kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return personal_data.find(docs).select(
        "doc_id", *counts, F.sha2(F.encode(personal_data.listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        personal_data.listed(F.concat("base", "added")).alias("spans"))


def _over(step, *tables: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return step(*(read(spark, sf_dir, t) for t in tables))
    return run


QUERIES = {
    "op1_sharding": _over(shard_documents, "documents"),
    "op2_decontamination": _over(contamination, "documents", "benchmark"),
    "op3_ngram_jaccard": _over(near_duplicates, "documents"),
    "op4_line_dedup": _over(repeated_lines, "documents"),
    "op5_language_id": _over(languages, "documents"),
    "op6_quality": _over(qualities, "documents", "labels"),
    "op7_topk": _over(neighbours, "embeddings"),
    "op8_mixing": _over(mixture, "documents"),
    "op9_suffix_dedup": _over(repeated_bytes, "documents"),
    "op10_licence_scan": _over(licence_scan, "documents"),
    "op11_hard_negatives": _over(mined_negatives, "embeddings"),
    "op12_vector_codes": _over(vector_codes, "embeddings"),
    "op13_personal_data": _over(personal, "documents"),
}
SQL: dict[str, str] = oracle.SQL
