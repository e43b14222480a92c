"""Lines that repeat across documents, found through two Bloom filters.

A line's key is the line without blanks at its ends and with A-Z lower-cased; keys of at
least ``LEAST`` characters count.  One pass puts the hash of every key into a filter of keys
seen once, and keys that are in it already into a filter of keys seen twice.  All bits of a
key lie in one 64-bit word, so filters of different tasks merge word by word: what both hold
as seen once is seen twice.  Only lines found in the second filter are shuffled, as 128-bit
digests, to confirm the repeat and choose the smallest doc_id.  A filter that is too small
for its input lets more lines through to that step; the result stays the same.

Rows with one doc_id are one document.  A null doc_id counts as one document that comes
after all others.  Null and empty texts have one empty line.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm import flow
from edgetide.llm.flow import Tables

LEAST = 10
BITS_PER_LINE = 16
MAX_BITS = 1 << 28     # 32 MB: the most a filter takes on the driver and in a task
BLANKS = b" \t\n\r\x0b\x0c"
WORDS = 1024           # of a filter block


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes) -> bool:
    """At least ``LEAST`` characters: bytes that continue a character don't count."""
    n = len(key)
    if n < LEAST:
        return False
    return n >= 4 * LEAST or key.isascii() or len(key.decode("utf-8", "replace")) >= LEAST


def lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of each hash and its bits there (four of 64)."""
    u = np.uint64
    mask = np.zeros(len(hashes), u)
    for shift in (0, 6, 12, 18):
        mask |= u(1) << ((hashes >> u(shift)) & u(63))
    return (hashes >> u(24)) % u(words), mask


def _hashes(text: bytes | None) -> set[int]:
    return {xxhash.xxh3_64_intdigest(k) for k in map(key_of, lines(text)) if long_enough(k)}


FILTER = pa.schema([("block", pa.int32()), ("payload", pa.binary())])


def merge_into(once: np.ndarray, twice: np.ndarray, once2: np.ndarray, twice2: np.ndarray) -> None:
    twice |= twice2 | (once & once2)
    once |= once2


def _fill(words: int) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in rows:
            found = [h for text in batch["text"] for h in _hashes(text.as_py())]
            at, mask = _places(np.array(found, np.uint64), words)
            # equal words of a batch one after the other, in as many turns as the fullest has
            order = np.argsort(at, kind="stable")
            at, mask = at[order], mask[order]
            while len(at):
                first = np.concatenate([[True], at[1:] != at[:-1]])
                a, m = at[first], mask[first]
                twice[a] |= np.where(once[a] & m == m, m, np.uint64(0))
                once[a] |= m
                at, mask = at[~first], mask[~first]
        both = np.stack([once.reshape(-1, WORDS), twice.reshape(-1, WORDS)], axis=1)
        used = np.flatnonzero(both.any(axis=(1, 2))).tolist()
        yield from flow.batches(((b, zlib.compress(both[b].tobytes(), 1)) for b in used), FILTER)
    return run


def _merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in rows:
        for block, payload in zip(batch["block"].to_pylist(), batch["payload"]):
            part = np.frombuffer(zlib.decompress(payload.as_py()), np.uint64).reshape(2, WORDS)
            if block in held:
                merge_into(*held[block], *part)
            else:
                held[block] = part.copy()
    yield from flow.batches(((b, zlib.compress(v[1].tobytes(), 1)) for b, v in held.items()
                             if v[1].any()), FILTER)


SUSPECT = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])


def digest(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(key)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _suspects(twice) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            table = twice.value
            for batch in rows:
                for i, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    keys = sorted({k for k in map(key_of, lines(text.as_py())) if long_enough(k)})
                    at, mask = _places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64),
                                       len(table))
                    for k in np.flatnonzero(table[at] & mask == mask).tolist():
                        yield i, *digest(keys[k])
        yield from flow.batches(found(), SUSPECT, 20000)
    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                  ("kept", pa.binary()), ("kept_sha256", pa.string())])


def _kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def texts():
        for batch in rows:
            for i, text, drop in zip(batch["doc_id"].to_pylist(), batch["text"], batch["drop"]):
                every = lines(text.as_py())
                gone = {(x["d1"], x["d2"]) for x in drop.as_py() or ()}
                left = [x for x in every if not (gone and long_enough(k := key_of(x)) and digest(k) in gone)]
                body = b"\n".join(left)
                yield i, len(every), len(every) - len(left), body, hashlib.sha256(body).hexdigest()
    yield from flow.batches(texts(), KEPT, 200)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit(b"\n"), F.lit(b"")))
    n = docs.agg(F.sum(breaks + 1)).first()[0] or 1
    words = WORDS
    while words < MAX_BITS // 64 and words * 64 < BITS_PER_LINE * n:
        words *= 2
    filled = docs.select("text").mapInArrow(_fill(words), "block int, payload binary")
    merged = filled.repartition("block").mapInArrow(_merge, "block int, payload binary")
    twice = np.zeros((words // WORDS, WORDS), np.uint64)
    with flow.settings(spark, flow.BATCH):
        for block, payload in merged.collect():     # the filter, MAX_BITS at most
            twice[block] = np.frombuffer(zlib.decompress(payload), np.uint64)
    held = spark.sparkContext.broadcast(twice.reshape(-1))
    suspects = tables.stage(docs.mapInArrow(_suspects(held), "doc_id long, d1 long, d2 long"), "suspects")

    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    repeats = tables.stage(suspects.groupBy("d1", "d2").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
                           .filter("lo <> hi"), "repeats")
    drops = suspects.join(repeats, ["d1", "d2"]).filter(row != F.col("lo")) \
        .groupBy("doc_id").agg(F.collect_set(F.struct("d1", "d2")).alias("drop"))
    drops = tables.stage(drops.withColumnRenamed("doc_id", "from_id"), "drops")
    tables.drop(suspects, repeats)
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("from_id")), "left")
    return joined.select("doc_id", "text", "drop").mapInArrow(
        _kept, "doc_id long, n_lines long, n_dropped long, kept binary, kept_sha256 string")
