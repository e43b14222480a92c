"""Hard negatives by inner product, with bounds from summaries of vector segments.

A segment of L components is summed up by its mean m and deviation s.  For two vectors
``L * (m m' - s s') <= segment product <= L * (m m' + s s')``, so the sums over the segments bound
the score.  Segments are refined by ``FAN``: one for the whole vector, then ``FAN``, ``FAN**2``, ...;
a pair goes on to the next level, and at last to its exact score, while its bounds meet what its
anchor still looks for.

Rows are laid out once in range blocks of (length, label, signs of segment means, id) and stored as
pages of at most ``PAGE`` rows of one label, each with the ranges of its segments' means and their
greatest deviations.  At most ``BOXES`` runs of blocks have such ranges on the driver: anchors are
sent, packed, to the blocks of those boxes that can hold a row they look for.  A task holds
the pages of one block and lets the packs of anchors pass by.  Two rounds do this: the first
finds the positives in the blocks of the anchor's label, the second the negatives, whose scores
must lie in windows that the positives' scores set.

Defined results: rows with a null id or label, or whose vector takes no part (``vectors.floored``),
are left out; a table without rows or anchors gives no rows.  Vectors of another length than the
anchor's aren't its candidates.  A repeated row counts by itself: as a candidate it is listed as
often as it occurs, as an anchor it has a list for each time; rows with an anchor's id are
never its positives.  Equal scores go to the smaller id.  Scores beyond a long count as the
largest or smallest long; products too large for a double are made with whole Python numbers.
Columns other than id, label and vector play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgetide.llm.flow import Tables
from edgetide.llm.vectors import floored

PAGE = 512              # rows of a page
CELL = 4 << 20          # components of a block: 32 MB
BOXES = 4096            # summaries held by the driver and sent to tasks
LAID = 8                # segments of a page's and a box's summary
FAN = 4                 # a segment is refined into so many
FINEST = 4              # components of the smallest segment
DENSE = 0.2             # share of pairs from which whole products are cheaper
LONG = (1 << 63) - 1
EXACT = 2.0 ** 53
MARGIN = 1e-9           # of bounds, for rounding

PAGES = ("block int, page int, dim int, label long, head binary, body binary, low array<double>, "
         "high array<double>, wide array<double>")
PAGE_SCHEMA = pa.schema([("block", pa.int32()), ("page", pa.int32()), ("dim", pa.int32()), ("label", pa.int64()),
                         ("head", pa.binary()), ("body", pa.binary()), *[(c, pa.list_(pa.float64())) for c in (
                             "low", "high", "wide")]])
#: What flows through a search: the pages of a block (``head``: ids), then packs of anchors
#: (``head``: row, id and label of each, ``windows``: least and greatest score of each window).
STREAM = "block int, page int, dim int, label long, head binary, body binary, windows binary"
STREAM_SCHEMA = pa.schema([("block", pa.int32()), ("page", pa.int32()), ("dim", pa.int32()), ("label", pa.int64()),
                           ("head", pa.binary()), ("body", pa.binary()), ("windows", pa.binary())])
PACK = (1 << 31) - 1    # in place of a page number: after all pages
BOX = "box int, dim int, first long, last long, low array<double>, high array<double>, wide array<double>"
FOUND = "row long, anchor_id long, id long, score long"
FOUND_SCHEMA = pa.schema([(c, pa.int64()) for c in ("row", "anchor_id", "id", "score")])


# --- summaries

def edges(dim: int, parts: int) -> np.ndarray:
    """Borders of ``parts`` segments of near-equal length."""
    parts = min(dim, parts)
    return np.arange(parts + 1) * dim // parts


def levels(dim: int) -> list[np.ndarray]:
    out, parts = [], 1
    while parts == 1 or dim // parts >= FINEST:
        out.append(edges(dim, parts))
        parts *= FAN
    return out


def summary(body: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, both times the root of the segment's length.

    Where a double overflows they are no numbers, and bounds made of them rule nothing out.
    """
    length = np.diff(cuts).astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.add.reduceat(body, cuts[:-1], axis=1) / np.sqrt(length)
        square = np.add.reduceat(body * body, cuts[:-1], axis=1)
        return mean, np.sqrt(np.maximum(square - mean * mean, 0.0) + 1e-12 * square)


def box_bounds(mean: np.ndarray, wide: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each anchor (row) with any vector of each box (column)."""
    up, down = np.maximum(mean, 0), np.minimum(mean, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        spread = wide @ most.T
        return up @ low.T + down @ high.T - spread, up @ high.T + down @ low.T + spread


# --- pages

def columns(rb: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rb.column(n).to_numpy(zero_copy_only=False) for n in names]


def records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def pack_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows (block, dim, label, id, vec) as pages of one block, length and label."""
    key, held, count, number = None, [], 0, 0

    def page() -> pa.RecordBatch:
        ids, body = (np.concatenate(x) for x in zip(*held))
        mean, wide = summary(body, edges(key[1], LAID))
        return records([(key[0], number, *key[1:], ids.tobytes(), body.tobytes(), mean.min(axis=0),
                         mean.max(axis=0), wide.max(axis=0))], PAGE_SCHEMA)

    for rb in batches:
        block, dim, label, ids = columns(rb, "block", "dim", "label", "id")
        values, at = rb.column("vec").flatten().to_numpy(zero_copy_only=False), 0
        changes = (np.diff(block) != 0) | (np.diff(dim) != 0) | (np.diff(label) != 0)
        borders = [0, *(np.flatnonzero(changes) + 1).tolist(), len(ids)]
        for a, b in zip(borders, borders[1:]):
            if a == b:
                continue
            own = (int(block[a]), int(dim[a]), int(label[a]))
            body = values[at:at + (b - a) * own[1]].reshape(-1, own[1])
            at += body.size
            while a < b:
                if held and (own != key or count == PAGE):
                    yield page()
                    held, count, number = [], 0, number + 1
                key, take = own, min(b - a, PAGE - count)
                held.append((ids[a:a + take], body[:take]))
                a, body, count = a + take, body[take:], count + take
    if held:
        yield page()


def merge_boxes(key: tuple, pages: pd.DataFrame) -> pd.DataFrame:
    """The pages of one box and length as one row: the ranges over all of them."""
    low, high, wide = (np.stack(pages[c].to_list()) for c in ("low", "high", "wide"))
    return pd.DataFrame([{"box": int(key[0]), "dim": int(key[1]), "first": int(pages["label"].min()),
                          "last": int(pages["label"].max()), "low": low.min(axis=0).tolist(),
                          "high": high.max(axis=0).tolist(), "wide": wide.max(axis=0).tolist()}])


def needed(body: np.ndarray, windows: np.ndarray, label: np.ndarray, boxes: dict) -> np.ndarray:
    """Which anchor (row) may find a score in its windows in which box (column)."""
    real = windows[:, :, 0] <= windows[:, :, 1]
    floor = np.where(real, windows[:, :, 0], LONG).min(axis=1, initial=LONG).astype(float)[:, None]
    cap = np.where(real, windows[:, :, 1], -LONG).max(axis=1, initial=-LONG).astype(float)[:, None]
    mean, wide = summary(body, edges(body.shape[1], LAID))
    least, most = box_bounds(mean, wide, boxes["low"], boxes["high"], boxes["wide"])
    slack = MARGIN * (np.abs(least) + np.abs(most)) + MARGIN
    # written so that a bound that is no number rules nothing out
    out = ~((most + slack < floor) | (least - slack > cap)) & real.any(axis=1)[:, None]
    return out & ~((boxes["first"] == label) & (boxes["last"] == label))


def send(boxes: dict[int, dict], near: bool) -> Callable:
    """Anchors (row, id, dim, label, vec, lows, highs) as a pack for each block they need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            row, ids, dims, labels = columns(rb, "row", "id", "dim", "label")
            for dim in np.unique(dims).tolist():
                here, box = np.flatnonzero(dims == dim), boxes[dim]
                lows, highs, vec = (rb.column(n).take(pa.array(here)) for n in ("lows", "highs", "vec"))
                body = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                count = np.diff(lows.offsets.to_numpy())
                windows = np.tile(np.array([1, 0], np.int64), (len(here), int(count.max()), 1))
                spot = np.arange(windows.shape[1]) < count[:, None]
                for k, bound in enumerate((lows, highs)):
                    windows[:, :, k][spot] = bound.flatten().to_numpy(zero_copy_only=False)
                head = np.stack([row[here], ids[here], labels[here]], axis=1)
                own = labels[here][:, None]
                wanted = ((box["first"] <= own) & (own <= box["last"]) if near
                          else needed(body, windows, own, box))
                for k in np.flatnonzero(wanted.any(axis=0)).tolist():
                    pick = wanted[:, k]
                    pack = (PACK, dim, 0, head[pick].tobytes(), body[pick].tobytes(), windows[pick].tobytes())
                    for block in range(box["start"][k], box["end"][k]):
                        yield records([(block, *pack)], STREAM_SCHEMA)
    return run


# --- searching a block

class Best:
    """The best ``k`` of each slot, highest score and then smallest id first."""

    def __init__(self, slots: int, k: int):
        self.k, self.kept = k, 0
        self.limit = np.full(slots, -LONG, np.int64)     # a slot's k-th score, once it has k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        good = score >= self.limit[slot]
        self.slot, self.score, self.id = (np.concatenate([a, b[good]]) for a, b in (
            (self.slot, slot), (self.score, score), (self.id, id)))
        if len(self.slot) > 2 * self.kept + 4096:
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.id, -self.score, self.slot))
        slot = self.slot[order]
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(starts, append=len(slot)))
        last = order[place == self.k - 1]
        self.limit[self.slot[last]] = self.score[last]
        order = order[place < self.k]
        self.slot, self.score, self.id = self.slot[order], self.score[order], self.id[order]
        self.kept = len(order)

    def pairs(self, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, id, score) of every row that a slot of the anchor holds, once for all its slots."""
        entry = np.stack([self.slot, self.score, self.id], axis=1)
        fresh = np.r_[True, (entry[1:] != entry[:-1]).any(axis=1)][:len(entry)]
        starts = np.flatnonzero(fresh)
        copy = np.arange(len(entry)) - np.repeat(starts, np.diff(starts, append=len(entry)))
        once = np.unique(np.stack([self.slot // slots, self.score, self.id, copy], axis=1), axis=0)
        return once[:, 0], once[:, 2], once[:, 1]


class Page:
    """A page with the summaries of its rows at all levels."""

    def __init__(self, dim: int, label: int, head: bytes, body: bytes):
        self.dim, self.label, self.ids = dim, label, np.frombuffer(head, np.int64)
        self.body = np.frombuffer(body).reshape(-1, dim)
        self.levels = [summary(self.body, cuts) for cuts in levels(dim)]
        mean, wide = summary(self.body, edges(dim, LAID))
        self.low, self.high, self.wide = mean.min(axis=0), mean.max(axis=0), wide.max(axis=0)
        self.big = np.abs(self.body).max(axis=1) >= np.sqrt(EXACT / dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows in whole Python numbers, as longs."""
    whole = [np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -LONG, LONG).astype(np.int64)


def scored_pairs(body: np.ndarray, big: np.ndarray, own: list, page: Page, floor: np.ndarray, cap: np.ndarray,
                 here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score) of the pairs their bounds leave, for the anchors in ``here``;
    the pairs scored."""
    rows, scored = np.arange(len(page.ids)), 0
    out: list[tuple] = []
    for a, r in ((here[big[here]], rows), (here[~big[here]], rows[page.big])):
        if len(a) and len(r):
            out.append((np.repeat(a, len(r)), np.tile(r, len(a)), products(body[a], page.body[r]).ravel()))
            scored += len(a) * len(r)
    a, r = here[~big[here]], rows[~page.big]
    open_ = np.ones((len(a), len(r)), bool)
    for (ma, wa), (mr, wr) in zip(own, page.levels):
        if not open_.any():
            break
        keep_a, keep_r = open_.any(axis=1), open_.any(axis=0)
        a, r, open_ = a[keep_a], r[keep_r], open_[np.ix_(keep_a, keep_r)]
        middle, spread = ma[a] @ mr[r].T, wa[a] @ wr[r].T
        slack = MARGIN * (np.abs(middle) + spread) + MARGIN
        open_ &= (middle + spread + slack >= floor[a][:, None]) & (middle - spread - slack <= cap[a][:, None])
    i, j = np.nonzero(open_)
    if len(i):
        if len(i) > DENSE * open_.size:
            score = (body[a] @ page.body[r].T)[i, j]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", body[a[i[k:k + 65536]]], page.body[r[j[k:k + 65536]]])
                                    for k in range(0, len(i), 65536)])
        out.append((a[i], r[j], score.astype(np.int64)))
        scored += len(i)
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), scored)
    return (*(np.concatenate(x) for x in zip(*out)), scored)


def search_pages(pages: list[Page], dim: int, head: np.ndarray, body: np.ndarray, windows: np.ndarray, near: bool,
                 k: int) -> tuple[Best, int]:
    """A pack of anchors against the pages of its block; the pairs whose products were made."""
    pages = [p for p in pages if p.dim == dim]
    row_id, label, slots = head[:, 1], head[:, 2], 1 if near else windows.shape[1]
    best, scored = Best(len(head) * slots, k), 0
    if not pages or not slots:
        return best, scored
    low, high = ((np.full((len(head), 1), v, np.int64) for v in (-LONG, LONG)) if near
                 else (windows[:, :, 0], windows[:, :, 1]))
    real = low <= high
    cap = np.where(real, high, -LONG).max(axis=1)
    big = np.abs(body).max(axis=1) >= np.sqrt(EXACT / dim)
    own = [summary(body, cuts) for cuts in levels(dim)]
    least, most = box_bounds(*summary(body, edges(dim, LAID)), *(np.stack([getattr(p, c) for p in pages])
                                                               for c in ("low", "high", "wide")))
    slack = MARGIN * (np.abs(least) + np.abs(most)) + MARGIN
    for n in np.argsort(-np.nan_to_num(most.mean(axis=0)), kind="stable").tolist():
        page = pages[n]
        # what an anchor still looks for: above its windows' floors and their k-th scores
        floor = np.where(real, np.maximum(low, best.limit.reshape(-1, slots)), LONG).min(axis=1)
        here = np.flatnonzero((label == page.label if near else label != page.label) & real.any(axis=1)
                              & ~(most[:, n] + slack[:, n] < floor) & ~(least[:, n] - slack[:, n] > cap))
        if not len(here):
            continue
        a, r, score, made = scored_pairs(body, big, own, page, floor, cap, here)
        scored += made
        if near:
            other = page.ids[r] != row_id[a]
            best.add(a[other], score[other], page.ids[r[other]])
            continue
        for j in range(slots):
            fits = (low[a, j] <= score) & (score <= high[a, j])
            best.add(a[fits] * slots + j, score[fits], page.ids[r[fits]])
    best.cut()
    return best, scored


def search(near: bool, k: int) -> Callable:
    """The best of each block for the packs sent to it; blocks follow one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pages = None, []
        for rb in batches:
            for r in rb.to_pylist():
                if r["block"] != block:
                    block, pages = r["block"], []
                if r["page"] != PACK:
                    pages.append(Page(r["dim"], r["label"], r["head"], r["body"]))
                    continue
                head = np.frombuffer(r["head"], np.int64).reshape(-1, 3)
                windows = np.frombuffer(r["windows"], np.int64).reshape(len(head), -1, 2)
                best, _ = search_pages(pages, r["dim"], head, np.frombuffer(r["body"]).reshape(len(head), -1),
                                       windows, near, k)
                anchor, ids, score = best.pairs(max(1, windows.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                    head[anchor, 0], head[anchor, 1], ids, score)], schema=FOUND_SCHEMA)
    return run


# --- the whole

def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The first ``k`` of each group over all blocks, with their ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def laid_out(whole: DataFrame, tables: Tables) -> tuple[DataFrame, int, dict[int, dict]]:
    """Pages in range blocks, the number of blocks, and the boxes of each vector length."""
    spark = whole.sparkSession
    n, values = whole.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-values // CELL), min(parts, -(-n // (8 * PAGE))))
    order = ["dim", "label", "place", "id", "row"]
    pages = tables.stage(
        whole.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("block"), "dim", "label", "id", "vec")
        .mapInArrow(pack_pages, PAGES), "pages")
    per = -(-blocks // BOXES)
    merged = (pages.select((F.col("block") / per).cast("int").alias("box"), "dim", "label", "low", "high", "wide")
              .groupBy("box", "dim").applyInPandas(merge_boxes, BOX).orderBy("box").collect())
    boxes: dict[int, dict] = {}
    for dim in {b["dim"] for b in merged}:
        own = [b for b in merged if b["dim"] == dim]
        boxes[dim] = {c: np.array([b[c] for b in own], t) for t, names in (
            (np.int64, ("first", "last")), (float, ("low", "high", "wide"))) for c in names}
        boxes[dim] |= {"start": [b["box"] * per for b in own], "end": [(b["box"] + 1) * per for b in own]}
    return pages, blocks, boxes


def _round(pages: DataFrame, blocks: int, anchors: DataFrame, boxes: dict, near: bool, k: int) -> DataFrame:
    sent = anchors.select("row", "id", "dim", "label", "vec", "lows", "highs").mapInArrow(send(boxes, near), STREAM)
    both = pages.select("block", "page", "dim", "label", "head", "body", F.lit(b"").alias("windows")).union(sent)
    return (both.repartition(blocks, "block").sortWithinPartitions("block", "page")
            .mapInArrow(search(near, k), FOUND))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row in ``is_anchor`` and each of its ``positives`` best rows of the same label, the
    best ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive.
    """
    tables = Tables(rows.sparkSession)
    named = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    cut = F.size("vec") / F.lit(float(LAID))
    signs = F.aggregate(F.sequence(F.lit(0), F.lit(LAID - 1)), F.lit(0), lambda code, s: code * 2 + F.when(F.aggregate(
        F.slice("vec", (s * cut).cast("int") + 1, F.greatest(F.lit(1), cut.cast("int"))), F.lit(0.0),
        lambda t, x: t + x) > 0, 1).otherwise(0))
    whole = tables.stage(
        floored(named.filter(F.col("id").isNotNull() & F.col("label").isNotNull()), scale, "vector")
        .select("id", "label", "vec", "asks", F.size("vec").alias("dim"), signs.alias("place"),
                F.monotonically_increasing_id().alias("row")), "vectors")
    pages, blocks, boxes = laid_out(whole, tables)
    anchors = whole.filter("asks").drop("asks", "place")
    none = F.array().cast("array<long>")
    share = F.col("score").cast("decimal(20,0)")
    near = tables.stage(
        _first(_round(pages, blocks, anchors.withColumns({"lows": none, "highs": none}), boxes, True, positives),
               positives, "row").withColumns({"low": F.ceil(share * low / 100).cast("long"),
                                              "high": F.floor(share * high / 100).cast("long")}), "positives")
    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w")) \
        .select("row", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    far = _round(pages, blocks, anchors.join(windows, "row"), boxes, False, negatives).drop("anchor_id")
    each = far.join(near.select("row", "anchor_id", F.col("rank").alias("nth"), F.col("id").alias("positive_id"),
                                F.col("score").alias("positive_score"), "low", "high"), "row").filter(
        F.col("score").between(F.col("low"), F.col("high")))
    return _first(each, negatives, "row", "nth").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
