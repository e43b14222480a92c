"""Product codes of vectors: Lloyd's rounds with an equal-average search for the nearest entry.

Vectors are cut into equal consecutive parts; each part position has a codebook of its own.  For a
part x and an entry c of d components, ``(sum(x) - sum(c))**2 / d <= |x - c|**2``.  Entries are held
sorted by their sums: a search starts at the entry with the nearest sum and goes outward, always to
the side with the smaller gap, until the squared gap over d strictly exceeds the best distance.  All
parts of a batch go outward together, and those that are done drop out.

Each round is one pass over the stored vectors: a task adds up its own parts per entry, Spark adds
the tasks' sums, and the driver gets one row per part position, entry and component.  That and the
codebooks sent to the tasks have a size that doesn't depend on the number of vectors.

Everything is in whole numbers.  Batches whose numbers are so large that a long could overflow are
computed with whole Python numbers.

Defined results: rows whose vector takes no part (``vectors.floored``) or whose length is no multiple
of ``parts`` are left out; vectors of each length have codebooks of their own.  The first entries come
from the smallest ids, nulls last, equal ids by their vectors; fewer rows make fewer entries, no
rows make an empty table.  Repeated rows count as often as they occur, equal distances go to the
lower index.  An error or a sum of errors beyond a long is the largest long.  Columns other than those
named play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.flow import BATCH, Tables, settings
from edgetide.llm.flow import batches as record_batches
from edgetide.llm.vectors import floored
from edgetide.operators.ordered import join_same

LONG = (1 << 63) - 1
#: Up to this |component| times the part's length, squares of sums and of gaps fit a long.
SAFE = 1 << 28

#: Sums travel as pieces to the base ``BASE``, so that Spark adds longs of any total; place -1: counts.
BASE = 1 << 32
SUMS = "part int, entry int, place int, digit int, piece long"
SUMS_SCHEMA = pa.schema([(c, pa.int32()) for c in ("part", "entry", "place", "digit")] + [("piece", pa.int64())])
CODES = "id long, label long, code string, error long"
CODES_SCHEMA = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

Book = list[np.ndarray]      # per part position the entries, in whole Python numbers


def search(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each part's nearest entry, the squared distance, and the distances computed."""
    n, d = parts.shape
    sums = book.sum(axis=1)
    order = np.lexsort((np.arange(len(book)), sums)) if sums.dtype != object else np.array(
        sorted(range(len(book)), key=lambda k: (sums[k], k)))
    ranked, own = sums[order], parts.sum(axis=1)
    right = np.searchsorted(ranked, own)        # next entry upward; left is the next downward
    left = right - 1
    best = np.zeros(n, own.dtype)
    found = np.full(n, -1)
    live, made = np.arange(n), 0
    while len(live):
        lo, hi, s = left[live], right[live], own[live]
        none_lo, none_hi = lo < 0, hi >= len(book)
        gap_lo, gap_hi = np.abs(s - ranked[lo]), np.abs(ranked[np.minimum(hi, len(book) - 1)] - s)
        down = none_hi | (~none_lo & (gap_lo <= gap_hi).astype(bool))
        gap = np.where(down, gap_lo, gap_hi)
        # beyond this gap every entry on this side, and so on both, is strictly farther
        open_ = ~(none_lo & none_hi) & ((found[live] < 0) | (gap * gap <= best[live] * d).astype(bool))
        live, down = live[open_], down[open_]
        if not len(live):
            break
        entry = order[np.where(down, left[live], right[live])]
        left[live[down]] -= 1
        right[live[~down]] += 1
        away = parts[live] - book[entry]
        distance = (away * away).sum(axis=1)
        made += len(live)
        closer = (found[live] < 0) | (distance < best[live]).astype(bool) | (
            (distance == best[live]).astype(bool) & (entry < found[live]))
        best[live[closer]], found[live[closer]] = distance[closer], entry[closer]
    return found, best, made


def cut(vectors: np.ndarray, book: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """One part position of the vectors and its codebook, in longs if all results fit them."""
    d = vectors.shape[1] // parts
    own = vectors[:, part * d:(part + 1) * d]
    if max(np.abs(own).max(initial=0), max((abs(x) for x in book.flat), default=0)) * d <= SAFE:
        return own.astype(np.int64), book.astype(np.int64)
    return np.array([[int(x) for x in r] for r in own], dtype=object).reshape(own.shape), book


def matrix(rb: pa.RecordBatch, dim: int) -> np.ndarray:
    return rb.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(digit, piece) of a whole number to the base ``BASE``, pieces signed as it is."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        value, piece = divmod(value, BASE)
        if piece:
            yield k, sign * piece
        k += 1


def adding(books: Book, dim: int) -> Callable:
    """Sums and counts of the parts nearest to each entry, over one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, dtype=object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for rb in batches:
            vectors = matrix(rb, dim)
            for p, whole in enumerate(books if len(vectors) else ()):
                own, book = cut(vectors, whole, p, len(books))
                entry = search(own, book)[0]
                order = np.argsort(entry, kind="stable")
                starts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                totals[p][entry[order][starts]] += np.add.reduceat(own[order], starts, axis=0).astype(object)
                counts[p] += np.bincount(entry, minlength=len(book))
        rows = [(p, e, -1, 0, int(n)) for p, c in enumerate(counts) for e, n in enumerate(c) if n]
        rows += [(p, e, k, digit, piece) for p, t in enumerate(totals) for (e, k), v in np.ndenumerate(t)
                 for digit, piece in digits(int(v))]
        yield from record_batches(iter(rows), SUMS_SCHEMA)
    return run


def moved(books: Book, sums: DataFrame) -> Book:
    """Entries at the floor of their parts' means; entries without parts as they were."""
    totals = [np.zeros(b.shape, dtype=object) for b in books]
    counts = [np.zeros(len(b), dtype=object) for b in books]
    for part, entry, place, digit, piece in sums.groupBy("part", "entry", "place", "digit").agg(
            F.sum("piece")).collect():
        if place < 0:
            counts[part][entry] += piece
        else:
            totals[part][entry, place] += piece * BASE ** digit
    return [np.array([[x // int(n) for x in t] if n else list(b) for t, n, b in zip(total, count, book)],
                     dtype=object).reshape(book.shape) for total, count, book in zip(totals, counts, books)]


def coding(books: Book, dim: int) -> Callable:
    """Code and error of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            vectors, codes, error = matrix(rb, dim), [], 0
            for p, whole in enumerate(books):
                own, book = cut(vectors, whole, p, len(books))
                entry, distance, _ = search(own, book)
                codes.append(entry)
                error = error + distance
            names = ["".join(f"{e:02x}" for e in row) for row in np.stack(codes, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [rb.column("id"), rb.column("label"), pa.array(names, pa.string()),
                 pa.array([min(int(e), LONG) for e in error], pa.int64())], schema=CODES_SCHEMA)
    return run


def first_entries(own: DataFrame, parts: int, entries: int, dim: int) -> Book:
    rows = own.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").collect()
    whole = np.array([[int(x) for x in r[0]] for r in rows], dtype=object).reshape(len(rows), dim)
    d = dim // parts
    return [whole[:, p * d:(p + 1) * d] for p in range(parts)]


def digest(books: Book) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.flat).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             id: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, dict[int, Book]]:
    """(id, label, dim, code, error) of each row, and the codebooks of each vector length."""
    tables = Tables(rows.sparkSession)
    named = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).alias("vector"))
    whole = tables.stage(floored(named, scale, "vector").withColumn("dim", F.size("vec")).filter(
        F.col("dim") % parts == 0).select("id", "label", "vec", "dim"), "vectors")
    books: dict[int, Book] = {}
    out = rows.sparkSession.createDataFrame([], CODES).withColumn("dim", F.lit(0))
    for dim, in whole.select("dim").distinct().orderBy("dim").collect():      # a row per vector length
        own = whole.filter(F.col("dim") == dim)
        book = first_entries(own, parts, entries, dim)
        with settings(rows.sparkSession, BATCH):
            for _ in range(rounds):
                book = moved(book, own.select("vec").mapInArrow(adding(book, dim), SUMS))
        books[dim] = book
        coded = own.select("id", "label", "vec").mapInArrow(coding(book, dim), CODES).withColumn("dim", F.lit(dim))
        out = coded if len(books) == 1 else out.union(coded)
    return tables.stage(out, "codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``label_error``: errors summed over equal labels, null ones together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long")
    sums = Tables(codes.sparkSession).stage(codes.groupBy("label").agg(total.alias("label_error")), "label-errors")
    return join_same(codes, sums, ["label"])
