"""Near-duplicate groups by an exact n-gram Jaccard self-join with rare-first prefixes.

Words are runs of non-blank bytes, A-Z lower-cased; a text's set holds its distinct 5-word
shingles (with fewer words the whole sequence; without words nothing).  Two texts link when
``100 * both >= 80 * either``.

1. One pass hashes all texts, fingerprints their sets and counts every shingle in a table of
   2**22 counters.  Rows with equal sets are one from here on.
2. A set's shingles are ordered rarest first; two linked sets share one of their first
   ``n - ceil(0.8 n) + 1``.  Only these prefixes are shuffled, by shingle.
3. A shingle's sets meet its first few sets of their own size class, so that a group of N
   near copies gives some N pairs; those left after the length, positional and suffix filters
   are verified on the whole sets, once each.
4. Sets of one shingle which are not connected yet are then paired all the same, apart from
   pairs already tried.  No link that joins two groups can be missed, and pairs inside a
   group, which change nothing, are not made.

Null and empty texts link with nothing.  Rows that repeat a text are links of it; a null
doc_id takes part but is never the smallest of a group that has an id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm import flow
from edgetide.llm.components import components
from edgetide.llm.flow import Tables
from edgetide.llm.tokens import shingle_sets

SIZE = 5
COUNTERS = 22          # log2 of the shingle counters
LEADERS = 3            # sets of a size class every other set of a shingle is tried with first
BINS = 64              # of the suffix filter


def fingerprint(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else 0


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()),
                  ("set", pa.int64()), ("block", pa.int32()), ("payload", pa.binary())])


def _survey(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text, then this task's shingle counters."""
    counts = np.zeros(1 << COUNTERS, np.uint32)
    shift = np.uint64(64 - COUNTERS)

    def texts():
        for batch in rows:
            ids, keys = batch["doc_id"].to_pylist(), batch["key"].to_pylist()
            for i, grams in enumerate(shingle_sets(batch["text"], SIZE)):
                np.add.at(counts, grams >> shift, 1)
                yield ids[i], keys[i], len(grams), fingerprint(grams) if len(grams) else None, None, None
        for block, payload in flow.packed(counts):
            yield None, None, None, None, block, payload

    yield from flow.batches(texts(), SETS)


PREFIX = pa.schema([("token", pa.int64()), ("set", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _prefixes(rarity) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, shift = rarity.value, np.uint64(64 - COUNTERS)
        seen: set[int] = set()          # copies inside a task go once
        for batch in rows:
            tokens, sets, ns, at = [], [], [], []
            for grams in shingle_sets(batch["text"], SIZE):
                if not len(grams) or (own := fingerprint(grams)) in seen:
                    continue
                seen.add(own)
                first = prefix_length(len(grams))
                order = np.argsort(rank[grams >> shift], kind="stable")[:first]
                tokens.append(grams[order])
                sets.append(np.full(first, own, np.int64))
                ns.append(np.full(first, len(grams), np.int32))
                at.append(np.arange(first, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sets)),
                     pa.array(np.concatenate(ns)), pa.array(np.concatenate(at))], schema=PREFIX)
    return run


def close(n: str, pos: str, m: str, mpos: str):
    """Length and positional filters: the overlap still possible reaches 4/9 of both sizes."""
    rest = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(mpos))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * rest >= 4 * (F.col(n) + F.col(m)))


TRIED = pa.schema([("token", pa.int64()), ("set", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()),
                   ("other", pa.int64()), ("m", pa.int32()), ("mpos", pa.int32())])


def _stars(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, pos, set), streamed: the sets of each shared token, and with
    them the first sets of the same or a neighbouring size class.  Sets with few rarer shingles
    come first: of edited copies, those closest to what was copied.  Held at any time: the
    leaders of one token."""
    token, first, last, leaders = None, None, None, {}

    def steps():
        nonlocal token, first, last, leaders
        for batch in rows:
            columns = [batch[c].to_numpy() for c in ("token", "set", "n", "pos")]
            tokens = columns[0]
            # a row unlike both neighbours is alone; the ends of a batch stay open
            lone = np.zeros(len(tokens), bool)
            lone[1:-1] = (tokens[1:-1] != tokens[:-2]) & (tokens[1:-1] != tokens[2:])
            for row in zip(*(c[~lone].tolist() for c in columns)):
                t, s, n, _ = row
                level = int(math.log(n) / math.log(1.25))
                if t != token:
                    token, first, last, leaders = t, row, s, {level: [row]}
                    continue
                if s == last:
                    continue
                last = s
                if first is not None:
                    yield (*first, None, None, None)
                    first = None
                near = [x for k in (level - 1, level, level + 1) for x in leaders.get(k, ())]
                for other in near:
                    yield (*row, *other[1:])
                if not near:
                    yield (*row, None, None, None)
                if len(leaders.setdefault(level, [])) < LEADERS:
                    leaders[level].append(row)

    yield from flow.batches(steps(), TRIED, 20000)


WHOLE = pa.schema([("set", pa.int64()), ("bins", pa.list_(pa.int32())), ("grams", pa.binary())])


def _whole(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of fetched texts, with the counts of the suffix filter."""
    def sets():
        for batch in rows:
            wanted = batch["wanted"].to_pylist()
            for own, grams in zip(wanted, shingle_sets(batch["text"], SIZE)):
                if len(grams) and fingerprint(grams) == own:
                    bins = np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=BINS)
                    yield own, bins.tolist(), grams.tobytes()
    yield from flow.batches(sets(), WHOLE, 500)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def links():
        for batch in rows:
            for a, b, x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["x"], batch["y"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 9 * both >= 4 * (len(x) + len(y)):
                    yield a, b
    yield from flow.batches(links(), LINKS)


def _links(tables: Tables, docs: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of sets (a, b) that link, each verified once on whole sets."""
    wanted = (pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
              .join(firsts, "set"))
    whole = tables.stage(
        docs.join(wanted.select("doc_id", "key", F.col("set").alias("wanted")),
                  docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["key"] == wanted["key"]))
        .select("wanted", "text")
        .mapInArrow(_whole, "set long, bins array<int>, grams binary"), "whole")
    bins = whole.select("set", "bins")
    # suffix filter: per part of the hash range no more tokens can agree than the lesser count
    possible = F.aggregate(F.zip_with("x", "y", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v)
    likely = (pairs.join(bins.select(F.col("set").alias("a"), F.col("bins").alias("x")), "a")
              .join(bins.select(F.col("set").alias("b"), F.col("bins").alias("y")), "b")
              .filter(9 * possible >= 4 * (total("x") + total("y"))).select("a", "b"))
    grams = whole.select("set", "grams")
    links = tables.stage(
        likely.join(grams.select(F.col("set").alias("b"), F.col("grams").alias("y")), "b")
        .join(grams.select(F.col("set").alias("a"), F.col("grams").alias("x")), "a")
        .select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "links")
    tables.drop(whole)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, keeper) for every row of ``docs``.

    ``docs`` needs doc_id and text; ``key`` is ``flow.text_key`` of the text.  ``keeper``
    marks the row with the smallest (doc_id, key) of its component; rows that repeat one
    doc_id and text are all marked.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", flow.text_key().alias("key"))
    survey = tables.stage(docs.mapInArrow(
        _survey, "doc_id long, key long, n int, set long, block int, payload binary"), "survey")
    sets = survey.filter("block is null").select("doc_id", "key", "n", "set")
    counts = flow.gathered(survey.filter("block is not null"), 1 << COUNTERS, "uint32")
    # a byte per counter, 4 MB in all: finer than a fifth of an octave is not needed for an order
    rarity = spark.sparkContext.broadcast(
        np.minimum(255, 7 * np.log2(1.0 + counts)).astype(np.uint8))

    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    firsts = tables.stage(sets.filter("set is not null").groupBy("set").agg(F.min(row).alias("r"))
                          .select("set", "r.doc_id", "r.key"), "firsts")
    prefixes = docs.select("text").mapInArrow(
        _prefixes(rarity), "token long, set long, n int, pos int")
    shared = tables.stage(
        prefixes.repartition("token").sortWithinPartitions("token", "pos", "set")
        .mapInArrow(_stars, "token long, set long, n int, pos int, other long, m int, mpos int"), "shared")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = tables.stage(shared.filter(F.col("other").isNotNull() & close("n", "pos", "m", "mpos"))
                         .select(*ordered("set", "other")).distinct(), "tried")
    links = _links(tables, docs, firsts, tried)
    labels = components(tables, links)

    members = shared.select("token", "set", "n", "pos").distinct().join(
        labels.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "label", F.coalesce("label", "set"))
    members = tables.stage(members, "members")
    open_tokens = tables.stage(members.groupBy("token").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token"), "open")
    members = members.join(open_tokens, "token")
    left, right = members.alias("l"), members.select(
        "token", F.col("set").alias("other"), F.col("n").alias("m"), F.col("pos").alias("mpos"),
        F.col("label").alias("olabel")).alias("r")
    rest = tables.stage(
        left.join(right, "token").filter((F.col("set") < F.col("other")) & (F.col("label") != F.col("olabel"))
                                         & close("n", "pos", "m", "mpos"))
        .select(*ordered("set", "other")).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    tables.drop(shared)
    if not rest.isEmpty():
        links = links.union(_links(tables, docs, firsts, rest))
        labels = components(tables, links)

    grouped = firsts.join(labels.withColumnRenamed("node", "set"), "set", "left").select(
        "set", "doc_id", "key", F.coalesce("label", "set").alias("label"))
    least = grouped.groupBy("label").agg(F.min(row).alias("first"))
    classes = tables.stage(grouped.select("set", "label").join(least, "label").select(
        "set", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key")), "classes")
    joined = sets.join(classes, "set", "left")
    alone = F.col("set").isNull()
    return joined.select(
        "doc_id", "key", F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("component_id"))
                  & (F.col("key") == F.col("first_key")))).alias("keeper"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns kept; texts without words stay."""
    kept = near_duplicates(docs).filter("keeper and n_shingles > 0").select(
        F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    rows = flow.packed_rows(docs)
    once = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))) \
        .groupBy("kept_id", "kept_key").agg(F.first("row").alias("row"))
    wordless = rows.filter(~F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.select("row.*").union(wordless.select("row.*"))
