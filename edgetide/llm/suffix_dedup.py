"""Removal of long repeated byte strings, found by deep-shallow suffix sorting.

Every byte of a ``LENGTH``-byte string that also starts anywhere else goes.  Sorting all
suffixes of a corpus in one place is out of reach, so suffixes are first split by content:

1. Each ``LENGTH``-byte window picks the least hashed ``GRAM``-byte string in it.  Equal
   windows pick the same string at the same place, whichever text they are in, so only windows
   with an equal pick can be equal.  Runs of windows with one pick are one *segment*, some 100
   windows a row.  Picks met once drop out after a count that combines before its shuffle.
2. Segments with equal bytes (128-bit digest) repeat as a whole.
3. What is left, the ends of matches, is sorted in groups of one pick: what follows the pick
   and what precedes it, each by multikey quicksort on 8-byte symbols down to ``SHALLOW``
   bytes, and below that by blind tries.  Common prefixes of neighbours then tell for each
   window, (bytes before, bytes after), whether an equal one is in the group.
4. A pick with more than ``GROUP`` different segments is dealt over several tasks; windows
   that repeat in none of them are compared across tasks by their digest.

Equal texts are one until the end.  Null is empty; windows never cross rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm import flow
from edgetide.llm.flow import Tables
from edgetide.llm.tokens import U, VALUES, flat, mixed, powers, prefix_sums

LENGTH = 400
GRAM = 200
SHALLOW = 32
GROUP = 4096
PIECE = 1 << 20        # bytes of a text looked at in one step; pieces overlap by a window

SEGMENT = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("m", pa.int32()), ("at", pa.int32()),
                     ("pick", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])


def _spans(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """(row, begin, end) of all rows with a window, cut at ``PIECE`` and packed to that size."""
    held, size = [], 0
    for row, (b, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while e - b >= LENGTH:
            end = min(e, b + PIECE)
            held.append((row, b, end))
            size += end - b
            if size >= PIECE:
                yield held
                held, size = [], 0
            if end == e:
                break
            b = end - LENGTH + 1
    if held:
        yield held


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring keys."""
    n = len(keys)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, U)
    full[:n] = keys
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def picks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start of ``data``: where its pick is, and the pick's hash."""
    sums = prefix_sums(data, VALUES)
    n = len(data) - GRAM + 1
    hashes = mixed((sums[GRAM:] - sums[:n]) * powers(len(data))[1][:n])
    # the place in the low bits: of equal strings in a window the first counts
    keys = (hashes & ~U((1 << 22) - 1)) | np.arange(n, dtype=U)
    least = sliding_least(keys, LENGTH - GRAM + 1)
    at = (least & U((1 << 22) - 1)).astype(np.int64)
    return at, hashes[at]


def _segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()

    def found():
        for batch in rows:
            data, offsets = flat(batch["text"])
            keys = batch["key"].to_pylist()
            for group in _spans(offsets):
                spans = []
                for row, b, e in group:
                    if b == offsets[row]:
                        if keys[row] in seen:
                            continue
                        if e == offsets[row + 1]:
                            seen.add(keys[row])
                    spans.append((row, b, e))
                if not spans:
                    continue
                joined = np.concatenate([data[b:e] for _, b, e in spans])
                at, hashes = picks(joined)
                body, begin = joined.tobytes(), 0
                for row, b, e in spans:
                    last = begin + (e - b) - LENGTH
                    own = at[begin:last + 1]
                    cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
                    for s, t, p, h in zip(cuts[:-1].tolist(), cuts[1:].tolist(),
                                          own[cuts[:-1]].tolist(),
                                          hashes[begin:][cuts[:-1]].view(np.int64).tolist()):
                        digest = xxhash.xxh3_128_intdigest(body[begin + s:begin + t - 1 + LENGTH])
                        yield (keys[row], b - int(offsets[row]) + s, t - s, p - begin - s, h,
                               (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63))
                    begin += e - b
    yield from flow.batches(found(), SEGMENT, 20000)


ITEM = pa.schema([("pick", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("key", pa.int64()),
                  ("start", pa.int64()), ("m", pa.int32()), ("at", pa.int32()), ("whole", pa.bool_()),
                  ("body", pa.binary())])


def _bodies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def items():
        for batch in rows:
            for text, wanted in zip(batch["text"], batch["items"].to_pylist()):
                body = text.as_py()
                for x in wanted:
                    yield (x["pick"], x["salt"], x["salts"], x["key"], x["start"], x["m"], x["at"],
                           x["whole"], body[x["start"]:x["start"] + x["m"] + LENGTH - 1])
    yield from flow.batches(items(), ITEM, 1000)


# --- deep-shallow sorting ---------------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Branches keep the depth and byte where strings part, not the strings in between.

    A string goes down by branching bytes alone, is compared with the leaf it ends at, and
    is put in where the two part.
    """

    def __init__(self, strings: list[bytes], members: list[int]):
        self.strings = strings
        self.root: list | tuple = [members[0]]
        for i in members[1:]:
            self._add(i)

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def _add(self, i: int) -> None:
        node = self.root
        while type(node) is tuple:
            node = node[1].get(self._byte(i, node[0])) or next(iter(node[1].values()))
        a, b = self.strings[i], self.strings[node[0]]
        depth = common(a, b)
        if depth == len(a) == len(b):
            node.append(i)
            return
        above, node = None, self.root
        while type(node) is tuple and node[0] < depth:
            above, node = node, node[1][self._byte(i, node[0])]
        if type(node) is tuple and node[0] == depth:
            node[1][self._byte(i, depth)] = [i]
            return
        leaf = node
        while type(leaf) is tuple:
            leaf = next(iter(leaf[1].values()))
        fork = (depth, {self._byte(leaf[0], depth): node, self._byte(i, depth): [i]})
        if above is None:
            self.root = fork
        else:
            above[1][self._byte(i, above[0])] = fork

    def in_order(self) -> Iterator[tuple[int, int]]:
        """(member, common prefix with the one before); -1 for the first."""
        stack = [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if type(node) is tuple:
                for k, c in sorted(node[1].items(), reverse=True)[:-1]:
                    stack.append((node[1][k], node[0]))
                stack.append((node[1][min(node[1])], before))
            else:
                for k, i in enumerate(node):
                    yield i, before if not k else len(self.strings[i])


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` inside each group, and the common prefix with the one before.

    The first string of a group has -1.  Multikey quicksort, one 8-byte symbol a level for
    all open groups at once, down to ``SHALLOW`` bytes; blind tries from there.
    """
    n = len(strings)
    heads = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    symbols = np.frombuffer(heads, ">u8").reshape(n, SHALLOW // 8).astype(U)
    order = np.argsort(groups, kind="stable")
    part = groups[order]
    part = np.concatenate([[0], np.cumsum(part[1:] != part[:-1])])
    top = np.concatenate([[True], part[1:] != part[:-1]])
    for level in range(SHALLOW // 8):
        own = symbols[order, level]
        turn = np.lexsort((own, part))
        order, own = order[turn], own[turn]
        new = np.concatenate([[0], (part[1:] != part[:-1]) | (own[1:] != own[:-1])]).cumsum()
        part = new
    out, lcp = order.copy(), np.full(n, -1, np.int64)
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [n]])
    for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if e - b > 1:
            for k, (i, before) in enumerate(BlindTrie(strings, order[b:e].tolist()).in_order()):
                out[b + k] = i
                lcp[b + k] = before
        if not top[b]:
            lcp[b] = common(strings[out[b - 1]], strings[out[b]])
    return out, lcp


def repeated_windows(groups: np.ndarray, bodies: list[bytes], at: np.ndarray, m: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all items as (item, start in the item, class, size of the class)."""
    after = [s[a + GRAM:] for s, a in zip(bodies, at.tolist())]
    before = [s[:a][::-1] for s, a in zip(bodies, at.tolist())]
    n = len(bodies)
    orders = []
    for strings, known in ((after, GRAM), (before, 0)):
        order, lcp = deep_shallow(strings, groups)
        orders.append((order, np.where(lcp < 0, -1, lcp + known)))
    found: list[tuple] = []
    nothing = np.zeros(n, np.int64)
    shift = 0
    for back in range(LENGTH - GRAM + 1):
        valid = np.flatnonzero((back <= at) & (back > at - m))
        if not len(valid):
            continue
        after_class, before_class = nothing.copy(), nothing.copy()
        for target, (order, lcp), depth in ((after_class, orders[0], LENGTH - back),
                                            (before_class, orders[1], back)):
            target[order] = np.cumsum(lcp < depth)
        both = after_class[valid] * (n + 1) + before_class[valid]
        _, which, sizes = np.unique(both, return_inverse=True, return_counts=True)
        found.append((valid, at[valid] - back, which + shift, sizes[which]))
        shift += len(sizes)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (nothing[:0],) * 4


SORTED = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("m", pa.int32()), ("known", pa.bool_()),
                    ("w1", pa.int64()), ("w2", pa.int64())])


def _sort_groups(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items sorted by (pick, salt): runs of repeated windows, and digests of windows that
    have to be compared with other parts of a dealt pick."""
    def solve(items: list[tuple]):
        items = list({(x[0], x[1], x[3], x[4]): x for x in items}.values())
        names = {}
        groups = np.array([names.setdefault((x[0], x[1]), len(names)) for x in items])
        bodies = [x[8] for x in items]
        at, m = (np.array([x[k] for x in items], np.int64) for k in (6, 5))
        item, start, which, size = repeated_windows(groups, bodies, at, m)
        whole = np.array([x[7] for x in items])
        again = (size > 1) & ~whole[item]
        turn = np.lexsort((start[again], item[again]))
        i, s = item[again][turn], start[again][turn]
        if len(i):
            cuts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1] + 1)]))
            for b, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)]):
                yield items[i[b]][3], items[i[b]][4] + int(s[b]), e - b, True, None, None
        dealt = np.array([x[2] > 1 for x in items])
        _, first = np.unique(which, return_index=True)
        for k in first[dealt[item[first]]].tolist():
            x, s = items[item[k]], int(start[k])
            digest = xxhash.xxh3_128_intdigest(x[8][s:s + LENGTH])
            yield (x[3], x[4] + s, 1, bool(size[k] > 1 or x[7]),
                   (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63))

    def runs():
        held, size, last = [], 0, None
        for batch in rows:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if x[:2] != last and size > 4 << 20:
                    yield from solve(held)
                    held, size = [], 0
                last = x[:2]
                held.append(x)
                size += len(x[8])
        if held:
            yield from solve(held)
    yield from flow.batches(runs(), SORTED, 5000)


def covered(spans: list, length: int) -> list[tuple[int, int]]:
    """Bytes covered by windows whose starts are given as (first, number), as runs."""
    out: list[tuple[int, int]] = []
    for first, m in sorted(spans):
        end = min(length, first + m - 1 + LENGTH)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


CLEAN = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(
    pa.list_(pa.int64()))), ("kept", pa.binary())])


def _cleaned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def texts():
        for batch in rows:
            for i, text, copies, spans in zip(*(batch[c] for c in ("doc_id", "text", "copies", "spans"))):
                body = text.as_py() or b""
                n = len(body)
                if copies.as_py() > 1:
                    runs = [(0, n)] if n >= LENGTH else []
                else:
                    runs = covered([(x["start"], x["m"]) for x in spans.as_py() or ()], n)
                kept, at = [], 0
                for b, e in runs:
                    kept.append(body[at:b])
                    at = e
                yield i.as_py(), n, [list(r) for r in runs], b"".join([*kept, body[at:]])
    yield from flow.batches(texts(), CLEAN, 200)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs`` (doc_id, text).

    ``spans`` holds the removed runs of bytes as [begin, end); ``kept`` the bytes left.
    """
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"),
                       flow.text_key().alias("key"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    texts = tables.stage(docs.groupBy("key").agg(least.alias("r"), F.count("*").alias("copies"))
                         .select("key", F.col("r.doc_id").alias("first_id"), "copies"), "texts")
    segments = tables.stage(docs.select("key", "text").filter(F.length("text") >= LENGTH).mapInArrow(
        _segments, "key long, start long, m int, at int, pick long, d1 long, d2 long"), "segments")
    place = F.xxhash64("key", "start")
    met = tables.stage(segments.groupBy("pick").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
                       .filter("lo <> hi").select("pick"), "met")
    shared = tables.stage(segments.join(met, "pick"), "shared")
    tables.drop(segments, met)
    classes = tables.stage(shared.groupBy("pick", "d1", "d2").agg(
        F.min(place).alias("lo"), F.max(place).alias("hi"),
        F.min(F.struct("key", "start", "m", "at")).alias("r"))
        .select("pick", "d1", "d2", "r.*", (F.col("lo") != F.col("hi")).alias("whole")), "classes")
    again = tables.stage(shared.join(classes.filter("whole").select("pick", "d1", "d2"), ["pick", "d1", "d2"])
                         .select("key", "start", "m"), "again")
    tables.drop(shared)

    open_picks = classes.groupBy("pick").agg(F.bool_and("whole").alias("done"), F.count("*").alias("c")) \
        .filter("not done and c > 1").select(
            "pick", F.ceil(F.col("c") / GROUP).cast("int").alias("salts"))
    items = classes.join(open_picks, "pick").select(
        "pick", F.pmod(F.xxhash64("key", "start"), "salts").cast("int").alias("salt"), "salts",
        "key", "start", "m", "at", "whole")
    per_text = items.groupBy("key").agg(F.collect_list(F.struct("*")).alias("items")).join(texts, "key")
    per_text = per_text.select(F.col("key").alias("rkey"), "first_id", "items")
    bodies = docs.join(per_text, F.col("doc_id").eqNullSafe(F.col("first_id"))
                       & (F.col("key") == F.col("rkey"))).select("text", "items") \
        .mapInArrow(_bodies, "pick long, salt int, salts int, key long, start long, m int, at int, "
                             "whole boolean, body binary")
    solved = tables.stage(
        bodies.repartition("pick", "salt").sortWithinPartitions("pick", "salt")
        .mapInArrow(_sort_groups, "key long, start long, m int, known boolean, w1 long, w2 long"), "solved")
    tables.drop(classes)
    across = solved.filter("w1 is not null")
    both = across.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"),
                                          F.bool_or("known").alias("known")).filter("lo <> hi or known")
    late = across.join(both.select("w1", "w2"), ["w1", "w2"]).select("key", "start", "m")
    found = again.union(solved.filter("w1 is null").select("key", "start", "m")).union(late)
    per_text = found.groupBy("key").agg(F.collect_list(F.struct("start", "m")).alias("spans"))
    results = tables.stage(texts.join(per_text, "key", "left"), "results")
    # a row that is not the first of its text is a copy, so no text key gathers many rows here
    joined = docs.join(results.withColumnRenamed("key", "rkey"), F.col("doc_id").eqNullSafe(
        F.col("first_id")) & (F.col("key") == F.col("rkey")), "left")
    return joined.select("doc_id", "text", F.coalesce("copies", F.lit(2)).alias("copies"), "spans") \
        .mapInArrow(_cleaned, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")
