"""Exact top-k by inner product through M-trees searched best first.

Vectors are integers.  An inner product becomes a distance by one more coordinate: with
``big`` the largest squared norm, x -> (x, sqrt(big - |x|^2)) and q -> (q, 0) give
``d^2 = |q|^2 + big - 2 q.x``, so the nearest rows score highest.

Rows are dealt over at most ``CELLS`` cells by place: a tree of halvings, fitted on a bounded
sample, says which cell a row is in; all rows are then placed, and every cell's radius covers
all its rows, so the sample decides speed and never results.  A cell is one M-tree of some
``TREE`` rows, or several that its rows are dealt over by hash, so a cell of equal vectors is
split like any other.  A tree is stored as pages of at most ``PAGE`` entries; an entry of an
inner page has its child's centre, covering radius and distance to the page's own centre, an
entry of a leaf a vector and that distance.

A query first goes through the trees of the cell nearest to it.  The score of its ``k``-th row
there bounds what other cells must hold, and it is sent only to those whose radius allows it.
In a tree it goes through a queue of pages ordered by the least distance they can hold; the
distances stored with the entries rule out many by the triangle inequality before a product is
computed.  Bounds carry a margin for rounding; scores are exact integer products, equal ones
go to the smaller id.  Where vectors form no clusters, few cells can be ruled out, and exact
search compares nearly all rows, in blocks of queries and trees.

Defined results: a vector that is null, empty or has a null or non-finite component takes no
part, nor does a row with a null id; vectors of other lengths than a query's aren't its
candidates.  Components of any finite size are taken; a score beyond a long counts as the
long nearest to it.  Each row is a row of its own: where an id is repeated, each of its rows is
a query with ranks of its own, and a candidate of the others.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgetide.llm.flow import Tables
from edgetide.llm.vectors import floored

TREE = 8192            # rows of a tree
PAGE = 64
QUERIES = 4096         # queries of a task
CELLS = 1024           # cells at most: their centres go to every task
SAMPLE = 32768         # rows that the halvings are fitted on
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def augmented(whole: np.ndarray, big: float) -> np.ndarray:
    """Vectors with the coordinate that brings all of them to one norm."""
    points = whole.astype(float)
    return np.concatenate([points, np.sqrt(np.maximum(big - (points ** 2).sum(axis=1), 0))[:, None]], axis=1)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Points by centres."""
    return np.stack([np.sqrt(((points - c) ** 2).sum(axis=1)) for c in centres], axis=1)


class Places:
    """Halvings of space fitted on a sample: a direction and a cut per node, a centre per cell."""

    def __init__(self, points: np.ndarray, cells: int):
        groups, self.levels = [np.arange(len(points))], []
        while len(groups) < cells:
            level, halves = [], []
            for g in groups:
                own = points[g] if len(g) else points[:1]
                far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
                other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
                along = other - far
                size = np.sqrt((along ** 2).sum())
                along = along / size if size > 0 else along
                cut = np.median(own @ along)
                right = points[g] @ along > cut
                level.append((along, cut))
                halves += [g[~right], g[right]]
            self.levels.append((np.array([d for d, _ in level]), np.array([c for _, c in level])))
            groups = halves
        self.centres = np.array([points[g].mean(axis=0) if len(g) else points[0] for g in groups])

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for along, cut in self.levels:
            at = 2 * at + ((points * along[at]).sum(axis=1) > cut[at])
        return at


def _split(points: np.ndarray, index: np.ndarray) -> list[np.ndarray]:
    """Two halves by the distance to a far point; ties in their order."""
    own = points[index]
    far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
    order = np.argsort(((own - far) ** 2).sum(axis=1), kind="stable")
    half = len(index) // 2
    return [index[order[:half]], index[order[half:]]]


def build_pages(points: np.ndarray) -> list[dict]:
    """Pages of one M-tree over ``points``; the last is the root."""
    groups = [np.arange(len(points))]
    while max(map(len, groups)) > PAGE:
        groups = [h for g in groups for h in (_split(points, g) if len(g) > PAGE else [g])]
    pages: list[dict] = []
    level = []
    for g in groups:
        centre = points[g].mean(axis=0)
        away = np.sqrt(((points[g] - centre) ** 2).sum(axis=1))
        level.append((len(pages), centre, away.max(), g))
        pages.append({"leaf": True, "entries": g, "parent": away})
    while len(level) > 1:
        above = []
        for k in range(0, len(level), PAGE):
            part = level[k:k + PAGE]
            centres = np.array([p[1] for p in part])
            radii = np.array([p[2] for p in part])
            every = np.concatenate([p[3] for p in part])
            centre = points[every].mean(axis=0)
            above.append((len(pages), centre,
                          np.sqrt(((points[every] - centre) ** 2).sum(axis=1)).max(), every))
            pages.append({"leaf": False, "entries": np.array([p[0] for p in part]), "centres": centres,
                          "radii": radii, "parent": np.sqrt(((centres - centre) ** 2).sum(axis=1))})
        level = above
    return pages


def exact(whole: np.ndarray, big: float) -> np.ndarray:
    """Whole doubles as integers whose products can't overflow."""
    if big < 2.0 ** 62:
        return whole.astype(np.int64)
    return np.array([int(x) for x in whole.reshape(-1).tolist()], object).reshape(whole.shape)


def search(pages: list[dict], ids: np.ndarray, names: np.ndarray, whole: np.ndarray, big: float,
           query: np.ndarray, own: int, k: int, known: int = LOW) -> tuple[list[tuple[int, int]], int]:
    """Best (score, id) of one tree for one query, and the number of rows compared.

    ``names`` tell rows apart, ``own`` is the query's; rows that score below ``known`` may be
    left out.
    """
    q = query.astype(float)
    length = float(q @ q) + big
    margin = 1e-7 * (length + 1)
    best: list[tuple[int, int]] = []            # heap: the worst first
    queue = [(0.0, len(pages) - 1, None)]
    seen = 0

    def reach() -> float:
        """Distance beyond which no row can enter."""
        worst = max(known, best[0][0]) if len(best) == k else known
        return np.inf if worst <= LOW else float(np.sqrt(max(0.0, length - 2.0 * worst + margin)))

    while queue:
        least, page, centre = heapq.heappop(queue)
        limit = reach()
        if least > limit:
            break
        node = pages[page]
        entries = node["entries"]
        if centre is not None:
            slack = np.abs(node["parent"] - centre) - (0 if node["leaf"] else node["radii"])
            open_ = slack <= limit + 1e-6 * (1 + limit) if np.isfinite(limit) else np.ones(len(entries), bool)
        else:
            open_ = np.ones(len(entries), bool)
        if node["leaf"]:
            rows = entries[open_]
            rows = rows[names[rows] != own]
            seen += len(rows)
            scores = whole[rows] @ query
            if scores.dtype == object:
                scores = np.array([min(HIGH, max(LOW, s)) for s in scores.tolist()], np.int64)
            good = scores >= (max(known, best[0][0]) if len(best) == k else known)
            top = sorted(zip((-scores[good].astype(object)).tolist(), ids[rows[good]].tolist()))[:k] if good.any() else []
            for s, i in ((-s, i) for s, i in top):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        else:
            centres = node["centres"][open_]
            away = np.sqrt(np.maximum(((centres[:, :-1] - q) ** 2).sum(axis=1) + centres[:, -1] ** 2, 0))
            bounds = np.maximum(0, away - node["radii"][open_])
            for child, d, low in zip(entries[open_].tolist(), away.tolist(), bounds.tolist()):
                if low <= limit + 1e-6 * (1 + limit):
                    heapq.heappush(queue, (low, child, d))
    return [(s, -i) for s, i in best], seen


def pages_of(frame: pd.DataFrame, big: float) -> pd.DataFrame:
    """One tree as rows of pages; a leaf page carries its ids, row names and vectors."""
    frame = frame.sort_values(["id", "row"], kind="stable")
    ids, names = frame["id"].to_numpy(np.int64), frame["row"].to_numpy(np.int64)
    whole = np.stack([np.asarray(v, float) for v in frame["vec"]])
    out = []
    for n, p in enumerate(build_pages(augmented(whole, big))):
        leaf, entries = p["leaf"], p["entries"]
        out.append({"tree": int(frame["tree"].iloc[0]), "dim": whole.shape[1], "page": n, "leaf": leaf,
                    "parent": p["parent"].tobytes(),
                    "ids": (ids[entries] if leaf else entries.astype(np.int64)).tobytes(),
                    "names": names[entries].tobytes() if leaf else b"",
                    "body": (whole[entries] if leaf else p["centres"]).tobytes(),
                    "radii": b"" if leaf else p["radii"].tobytes()})
    return pd.DataFrame(out)


PAGES = ("tree long, dim int, page int, leaf boolean, parent binary, ids binary, names binary, "
         "body binary, radii binary")
FOUND = "row long, query_id long, vec_id long, score long"


def search_group(tree: pd.DataFrame, queries: pd.DataFrame, big: float, k: int) -> pd.DataFrame:
    """All queries of a block through one tree."""
    found: list[tuple] = []
    if len(tree) and len(queries):
        pages, ids, names, whole, at = [], [], [], [], 0
        dim = int(tree["dim"].iloc[0])
        for p in tree.sort_values("page").itertuples():
            parent, entries = np.frombuffer(p.parent), np.frombuffer(p.ids, np.int64)
            if p.leaf:
                ids.append(entries)
                names.append(np.frombuffer(p.names, np.int64))
                whole.append(np.frombuffer(p.body).reshape(-1, dim))
                pages.append({"leaf": True, "parent": parent, "entries": np.arange(at, at + len(entries))})
                at += len(entries)
            else:
                pages.append({"leaf": False, "parent": parent, "entries": entries,
                              "centres": np.frombuffer(p.body).reshape(-1, dim + 1),
                              "radii": np.frombuffer(p.radii)})
        ids, names, whole = np.concatenate(ids), np.concatenate(names), exact(np.concatenate(whole), big)
        for q in queries.itertuples():
            got, _ = search(pages, ids, names, whole, big, exact(np.asarray(q.vec, float), big), q.row, k, q.known)
            found += [(q.row, q.id, i, s) for s, i in got]
    return pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"]).astype("int64")


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in frame["vec"]])


def _placing(places: Places, big: float) -> Callable:
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cell of each row and its distance from the cell's centre."""
        for frame in frames:
            if len(frame):
                points = augmented(_matrix(frame), big)
                cell = places.cell(points)
                yield frame.assign(cell=cell, away=np.sqrt(((points - places.centres[cell]) ** 2).sum(axis=1)))
    return place


def _homing(centres: np.ndarray, cells: np.ndarray) -> Callable:
    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cell that a query looks into first: the nearest of those with rows."""
        for frame in frames:
            if len(frame):
                q = np.pad(_matrix(frame), ((0, 0), (0, 1)))
                yield frame.assign(home=cells[distances(q, centres).argmin(axis=1)])
    return home


def _reaching(centres: np.ndarray, radii: np.ndarray, cells: np.ndarray, big: float) -> Callable:
    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other cells that may hold a row as good as the known score, for each query."""
        for frame in frames:
            if len(frame):
                vectors = _matrix(frame)
                length = (vectors ** 2).sum(axis=1) + big
                known = frame["known"].to_numpy(np.int64)
                limit = np.sqrt(np.maximum(length - 2.0 * known + 1e-7 * (length + 1), 0))
                limit[known <= LOW] = np.inf
                low = distances(np.pad(vectors, ((0, 0), (0, 1))), centres) - radii
                near = low <= (limit + 1e-6 * (1 + limit))[:, None]
                near &= cells[None, :] != frame["home"].to_numpy()[:, None]
                query, which = np.nonzero(near)
                yield frame.iloc[query].assign(cell=cells[which])
    return reach


def _paging(big: float) -> Callable:
    return lambda rows: pages_of(rows, big)


def _searching(big: float, k: int) -> Callable:
    return lambda tree, queries: search_group(tree, queries, big, k)


def _tree(cell: Column, part: Column) -> Column:
    return F.shiftleft(cell.cast("long"), 32) + part


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search_one_length(tables: Tables, own: DataFrame, n: int, big: float, k: int) -> DataFrame:
    """FOUND rows, up to ``k`` of each tree a query was sent to, for vectors of one length."""
    spark = own.sparkSession
    depth = min(CELLS, -(-n // TREE)) - 1
    sample = own.select("vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toPandas()
    places = Places(augmented(_matrix(sample), big), 1 << max(0, depth).bit_length())
    placed = tables.stage(own.select("row", "id", "vec", "asks").mapInPandas(
        _placing(places, big), "row long, id long, vec array<double>, asks boolean, cell long, away double"), "places")
    # one row per cell, CELLS at most
    sizes = placed.groupBy("cell").agg(F.count("*"), F.max("away")).orderBy("cell").collect()
    cells, radii = np.array([c for c, _, _ in sizes]), np.array([r for _, _, r in sizes]) * (1 + 1e-9)
    centres = places.centres[cells]
    parts = F.broadcast(spark.createDataFrame([(c, -(-m // TREE)) for c, m, _ in sizes], "cell long, parts long"))
    pages = tables.stage(
        placed.join(parts, "cell")
        .select("row", "id", "vec", _tree(F.col("cell"), F.pmod(F.xxhash64("row"), "parts")).alias("tree"))
        .groupBy("tree").applyInPandas(_paging(big), PAGES), "pages")
    asked = tables.stage(placed.filter("asks").select("row", "id", "vec").mapInPandas(
        _homing(centres, cells), "row long, id long, vec array<double>, home long"), "asked")
    tables.drop(placed)
    homes = asked.groupBy("home").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    asked = asked.join(F.broadcast(homes), "home").withColumn(
        "block", _tree(F.col("home"), F.pmod(F.xxhash64("row", F.lit(1)), "blocks"))).drop("blocks")

    def through(wanted: DataFrame) -> DataFrame:
        """Queries with the cell they are sent to, through all its trees; a tree goes where it is asked for."""
        sent = tables.stage(wanted.join(parts, "cell").select(
            "row", "id", "vec", "known", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
            .alias("part"), "cell").withColumn("tree", _tree(F.col("cell"), F.col("part"))).drop("cell", "part"), "sent")
        asking = sent.select("tree", F.col("block").alias("asker")).distinct()
        found = tables.stage(pages.join(asking, "tree").groupBy("tree", "asker").cogroup(sent.groupBy("tree", "block"))
                             .applyInPandas(_searching(big, k), FOUND), "found")
        tables.drop(sent)
        return found

    lowest = F.lit(LOW).cast("long")
    first = through(asked.withColumns({"cell": F.col("home"), "known": lowest}))
    if len(cells) == 1:
        return first
    last = _best(first, k).filter(F.col("rank") == k).select("row", F.col("score").alias("known"))
    second = through(asked.join(last, "row", "left").withColumn("known", F.coalesce("known", lowest)).mapInPandas(
        _reaching(centres, radii, cells, big),
        "home long, row long, id long, vec array<double>, block long, known long, cell long"))
    tables.drop(pages)
    return first.union(second)


def top_k(rows: DataFrame, is_query, k: int = 10, id: str = "vec_id", vector: str = "embedding"
          ) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` other rows of each row in ``is_query``."""
    tables = Tables(rows.sparkSession)
    used = floored(rows.filter(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("id"), F.col(vector).alias("_vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks")), 1024, "_vector").drop("_vector")
    # the numbers are written, so they stay the same for all later steps
    whole = tables.stage(used.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    size = whole.groupBy(F.size("vec").alias("dim")).agg(
        F.count("*").alias("n"), F.max(square).alias("big"),
        F.max("asks").alias("asked")).orderBy("dim").collect()   # a row per vector length
    out = None
    for dim, n, big, asked in size:
        if asked:
            found = _search_one_length(tables, whole.filter(F.size("vec") == dim), n, big, k)
            out = found if out is None else out.union(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], FOUND)
    return _best(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
