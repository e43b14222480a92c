"""Benchmark windows that occur in documents: a prefix-filtered set join, without Python.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all other characters.  A window
is ``WINDOW`` consecutive words of an item, or a shorter item as a whole; a document word
inside any occurrence of a window is hit.

A window that occurs needs all of its shingles to occur, so one of them, the rarest, is enough
to find it: with containment 1 the prefix of a window's shingles has length one.  Rarity is
counted over all windows and, for shingles of the benchmark, over all documents.

1. Each window keeps its rarest ``SHINGLE``-word shingle (a shorter window is one shingle) and
   the place of it.
2. A bitmap of those shingles, ``PER_KEY`` bits for each and ``MOST_BITS`` in all, goes to all tasks
   and leaves only the document positions that may match; just these are shuffled, by shingle,
   each with the few words around it.  A document's own words stay in the task that reads it.
3. A match fixes where the window would start; it must lie inside the document (length and
   positional bounds), and its words are compared one by one.

Null texts have no words.  Documents that repeat a doc_id and text get equal rows; item ids
are compared as strings, null ids don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm import flow
from edgetide.llm.flow import Tables

WINDOW = 10
SHINGLE = 5
LEAD = WINDOW - SHINGLE  # words of a window that may stand before its shingle
LEAST_BITS = 1 << 22   # 512 KB in every task
MOST_BITS = 1 << 25    # 4 MB; with over 2 million shingles more positions are compared in vain
PER_KEY = 16
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(word: Column) -> Column:
    """A-Z lower-cased; other letters stay as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, UPPER, LOWER))


def parts_of(text: Column) -> Column:
    """Words as they stand; capitals break no word."""
    return F.array_remove(F.split(text, BREAKS), "")


def words(text: str = "text") -> Column:
    """Folded words; a text that is ASCII is folded as a whole."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.octet_length(whole) == F.length(whole)
    return F.when(plain, parts_of(F.lower(whole))).otherwise(F.transform(parts_of(whole), folded))


def shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from 0-based ``at`` on; plain expressions, so compiled."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)], F.lit(size))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(window, win array<string>, size) of distinct windows, and their items."""
    listed = items.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"),
        words().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - WINDOW))
    return listed.select("item", F.explode(starts).alias("s"), "w").select(
        "item", F.slice("w", F.col("s") + 1, F.lit(WINDOW)).alias("win")).distinct()


def bits_for(keys: int) -> int:
    """A power of two, ``PER_KEY`` bits for each key as far as ``MOST_BITS`` goes."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, PER_KEY * keys):
        bits *= 2
    return bits


def places(h: Column, bits: int) -> list[Column]:
    return [F.pmod(x, F.lit(bits)) for x in (h, F.shiftrightunsigned(h, 32))]


def in_bitmap(bitmap: Column, h: Column, bits: int) -> Column:
    """Whether ``h`` may be among the bitmap's keys; true for each of them."""
    first, second = (F.getbit(F.get(bitmap, F.call_function("div", p, F.lit(64)).cast("int")), p % 64) == 1
                     for p in places(h, bits))
    return first & second


def bitmap_of(keys: DataFrame, bits: int) -> DataFrame:
    """One row: ``bits`` bits as an array of longs, its length fixed whatever the keys ``h``."""
    keys = keys.select(F.explode(F.array(*places(F.col("h"), bits))).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    used = keys.groupBy(F.call_function("div", "place", F.lit(64)).alias("id")).agg(F.bit_or(bit).alias("b"))
    every = keys.sparkSession.range(bits // 64).join(used, "id", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")))).alias("e")) \
        .select(F.transform("e", lambda x: x["b"]).alias("bits"))


def positions(docs: DataFrame, sizes: list[int], bitmap: Column, bits: int) -> DataFrame:
    """(doc_id, key, n, pos, h, near) of document shingles that are in the bitmap.

    ``near`` holds the words from ``LEAD`` before the position on, null outside the document.  All
    above the words of a document is compiled into one loop, so no row but these is made of them.
    """
    split = docs.select("doc_id", "key", words().alias("w"))
    out = None
    for size in sizes:
        starts = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size)) \
            .otherwise(F.array().cast("array<int>"))
        at = split.select("doc_id", "key", "w", F.explode(starts).alias("pos"))
        at = at.withColumn("h", shingle(F.col("w"), F.col("pos"), size)).filter(in_bitmap(bitmap, F.col("h"), bits))
        near = F.array(*[F.get("w", F.col("pos") + k) for k in range(-LEAD, WINDOW)])
        at = at.select("doc_id", "key", F.size("w").alias("n"), "pos", "h", near.alias("near"))
        out = at if out is None else out.union(at)
    return out


def window_hits(docs: DataFrame, items: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, key, win, start, size) of every verified occurrence; ``win`` names the window."""
    windows = benchmark_windows(items)
    size = F.least(F.lit(SHINGLE), F.size("win"))
    parts = windows.select("win", F.size("win").alias("length"), size.alias("size")).distinct() \
        .select("win", "length", "size", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))).alias("offset"))
    sizes = range(1, SHINGLE + 1)
    h = F.coalesce(*[F.when(F.col("size") == k, shingle(F.col("win"), F.col("offset"), k)) for k in sizes])
    parts = tables.stage(parts.select(F.concat_ws(" ", "win").alias("win"), "length", "size", "offset",
                                      h.alias("h")), "windows")
    used = sorted(r[0] for r in parts.select("size").distinct().collect())       # of five at most
    bits = bits_for(parts.select("h").distinct().count())
    bitmap = tables.stage(bitmap_of(parts, bits), "bitmap").scalar()
    found = positions(docs, used, bitmap, bits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, key long, win string, start int, size int")
    found = tables.stage(found, "positions")
    # the prefix of a window: its shingle in the fewest documents, then in the fewest windows
    rarity = parts.groupBy("h").agg(F.count("*").alias("in_windows")).join(
        found.groupBy("h").agg(F.count("*").alias("in_documents")), "h", "left")
    rank = F.struct(F.coalesce("in_documents", F.lit(0)).alias("d"), "in_windows", "h", "offset")
    prefix = tables.stage(parts.join(rarity, "h").groupBy("win").agg(
        F.min_by(F.struct("h", "offset", "length"), rank).alias("p")).select("win", "p.*"), "prefix")
    inside = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("length") <= F.col("n"))
    return found.join(prefix, "h").filter(inside).filter(
        F.slice("near", LEAD - F.col("offset") + 1, F.col("length")) == F.split("win", " ")).select(
        "doc_id", "key", "win", (F.col("pos") - F.col("offset")).alias("start"), F.col("length").alias("size"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, n_hit, item_ids) for every row of ``docs`` (doc_id, text)."""
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", flow.text_key().alias("key"))
    hits = tables.stage(window_hits(docs, items, tables).distinct(), "hits")
    spans = F.array_sort(F.collect_set(F.struct("start", "size")))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, x: F.struct(
        F.greatest(s["end"], x["start"] + x["size"]).alias("end"),
        (s["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(s["end"], x["start"]))).alias("n")),
        lambda s: s["n"].cast("long"))
    n_hit = hits.groupBy("doc_id", "key").agg(covered.alias("n_hit"))
    owners = benchmark_windows(items).select("item", F.concat_ws(" ", "win").alias("win"))
    owned = hits.select("doc_id", "key", "win").distinct().join(tables.stage(owners, "owners"), "win")
    ids = owned.select("doc_id", "key", "item").distinct().groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_list("item")).alias("item_ids"))
    found = n_hit.join(ids, n_hit["doc_id"].eqNullSafe(ids["doc_id"]) & (n_hit["key"] == ids["key"])).select(
        n_hit["doc_id"].alias("hit_id"), n_hit["key"].alias("hit_key"), "n_hit", "item_ids")
    found = tables.stage(found, "found")
    return docs.select("doc_id", "key", F.size(parts_of(F.coalesce("text", F.lit("")))).cast("long").alias("n_words")).join(
        found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def rows_without(docs: DataFrame, hits: DataFrame, tables: Tables) -> DataFrame:
    """``docs`` without the rows of the staged ``hits`` (hit_id, hit_key), all columns kept.

    A bitmap of the hits tells for most rows that they are none; only the others are shuffled.
    """
    rows = flow.packed_rows(docs)
    bits = bits_for(hits.count())
    bitmap = tables.stage(bitmap_of(hits.select(F.xxhash64("hit_id", "hit_key").alias("h")), bits), "marks").scalar()
    maybe = in_bitmap(bitmap, F.xxhash64("doc_id", "key"), bits)
    rest = rows.filter(maybe).join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id"))
                                   & (F.col("key") == F.col("hit_key")), "left_anti")
    return rows.filter(~maybe).select("row.*").union(rest.select("row.*"))
