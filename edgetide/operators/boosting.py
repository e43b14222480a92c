"""Leaf-wise boosted trees: Spark adds the histograms up, the driver picks the splits.

MLlib's trees grow level by level and know neither a leaf limit nor L1/L2 penalties.  Here a tree
always splits the leaf with the highest gain, until it has its number of leaves:

* features are cut once into at most ``BINS`` bins at exact quantiles of all rows;
* a pass over the rows gives one histogram (rows, slopes, curvatures) per new leaf, feature and
  bin.  Tasks send a histogram each, not rows, so a pass shuffles the same amount at any size;
* both children of every leaf the search would split are counted in one pass, so a tree takes as
  many passes as it is deep, and still is the one that splitting one leaf at a time gives;
* many fits (parameter sets, folds, labels) grow side by side and share each pass;
* slopes are summed as whole numbers, so neither the partitions nor a task run again after a
  lost executor change a result.

What the driver holds is bounded by the models: one row per fit, open leaf and feature.  Scores so
far are written with the rows every ``RESTAGE`` trees.  A missing feature value goes left, a row
without a label takes no part in that label's fits, and no rows give a model of constant 0.
"""

from __future__ import annotations

import heapq
import json
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from math import ceil, exp, log, log2, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.operators.models import LABELS, hash_bucket
from edgetide.operators.ordered import running_sum
from edgetide.staging import scope, stage

BINS = 63              # bins of present values; bin 0 holds the missing ones
UNIT = 2 ** 20         # parts into which a slope or curvature of 1 is cut
RESTAGE = 16           # trees after which the scores so far are written
TOGETHER = 48          # fits that share a pass: bounds a task's histograms to some 100 MB
LEAST_CURVATURE = 1e-3
HISTOGRAMS = "job int, slot int, feature int, cells binary"
CUTS = ("job int, slot int, feature int, n long, g long, h long, "
        "best struct<gain: double, back: int, ln: long, lg: long, lh: long>")
KEY, FOLD, SCORES = "_key", "_fold", "_scores"


@dataclass(frozen=True)
class Settings:
    """``depth`` -1: no limit.  ``row_share`` and ``feature_share`` are drawn anew for each tree."""

    trees: int = 100
    leaves: int = 31
    depth: int = -1
    rate: float = 0.1
    least_rows: int = 20
    row_share: float = 1.0
    feature_share: float = 1.0
    l1: float = 0.0
    l2: float = 0.0


@dataclass(frozen=True)
class Task:
    """One fit: a label, its loss, and the fold it doesn't see."""

    label: str
    logistic: bool
    settings: Settings = Settings()
    left_out: int | None = None
    unit: float = 1.0      # size of the label in whole steps, see ``_units``


@dataclass
class Tree:
    """Nodes in lists, node 0 the root; feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def rows_at(self, bins: np.ndarray, rows: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of each wanted leaf, of those given; ``bins`` is features x rows.

        A node's rows are cut in two once, and branches without a wanted leaf aren't followed.
        """
        leads = set(wanted)
        for node in reversed(range(len(self.feature))):  # children come after their parents
            if self.feature[node] >= 0 and (self.left[node] in leads or self.right[node] in leads):
                leads.add(node)
        open_ = [(0, rows)] if 0 in leads else []
        while open_:
            node, at = open_.pop()
            if self.feature[node] < 0:
                yield node, at
                continue
            goes_left = bins[self.feature[node]][at] <= self.cut[node]
            if self.left[node] in leads:
                open_.append((self.left[node], at[goes_left]))
            if self.right[node] in leads:
                open_.append((self.right[node], at[~goes_left]))

    def score(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The value of each row's leaf: of all rows in order, or of those given."""
        found = np.empty(bins.shape[1])
        leaves = [node for node, f in enumerate(self.feature) if f < 0]
        for node, at in self.rows_at(bins, np.arange(len(found)) if rows is None else rows, leaves):
            found[at] = self.value[node]
        return found if rows is None else found[rows]


@dataclass
class Model:
    task: Task
    features: list[str]
    borders: list[list[float]]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Model":
        raw = json.loads(text)
        task = Task(**{**raw["task"], "settings": Settings(**raw["task"]["settings"])})
        return Model(task, raw["features"], raw["borders"], raw["base"],
                     [Tree(**t) for t in raw["trees"]])

    def importance(self) -> list[tuple[str, float]]:
        """Share of each feature in the gain of all splits, highest first."""
        gains = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    gains[self.features[f]] += gain
        total = sum(gains.values()) or 1.0
        return sorted(((n, g / total) for n, g in gains.items()), key=lambda p: (-p[1], p[0]))


# --- bins -------------------------------------------------------------------------

def quantile_borders(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the upper ends of all bins but the last, from exact counts of its values.

    Values are counted before they are put in order, all features in one range shuffle.
    """
    pairs = [F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v"))
             for i, c in enumerate(features)]
    values = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    counts = values.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("f", "v").agg(
        F.count("*").alias("n"))
    upto = running_sum(counts, ["f"], ["v"], "n", "upto")
    totals = upto.groupBy("f").agg(F.max("upto").alias("total"))
    part = F.floor((F.col("upto") - F.col("n")) * bins / F.col("total"))
    ends = (upto.join(F.broadcast(totals), "f")  # one row per feature
            .groupBy("f", part.alias("part")).agg(F.max("v").alias("v")).collect())
    return [sorted(r.v for r in ends if r.f == i)[:-1] for i in range(len(features))]


def _bins(values: np.ndarray, borders: list[float]) -> np.ndarray:
    found = np.searchsorted(np.asarray(borders, dtype=np.float64), values, side="left") + 1
    return np.where(np.isnan(values), 0, found)


def binned(rows: DataFrame, key: str, features: list[str], labels: list[str],
           borders: list[list[float]], folds: int) -> DataFrame:
    """Key hash, fold, labels as doubles and one small number per feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [pa.array(_bins(_doubles(batch, f"_f{i}"), b).astype(np.int16))
                   for i, b in enumerate(borders)]
            kept = [batch.column(n) for n in (KEY, FOLD, *[f"_y{i}" for i in range(len(labels))])]
            yield pa.RecordBatch.from_arrays(kept + cut, names=names)
    names = [KEY, FOLD, *[f"_y{i}" for i in range(len(labels))], *[f"_b{i}" for i in range(len(features))]]
    fold = hash_bucket(F.concat(F.lit("fold"), F.col(key).cast("string")), folds)
    raw = rows.select(
        F.xxhash64(key).alias(KEY), fold.alias(FOLD),
        *[F.col(y).cast("double").alias(f"_y{i}") for i, y in enumerate(labels)],
        *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    schema = ", ".join([f"{KEY} long", f"{FOLD} int", *[f"_y{i} double" for i in range(len(labels))],
                        *[f"_b{i} short" for i in range(len(features))]])
    return raw.mapInArrow(run, schema)


def _doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


# --- what a task works out for its rows ---------------------------------------------

def _large(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one: what is done per fit and leaf is paid once a batch."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _draws(batch, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) per row, fixed by its key, the seed and the tree."""
    with np.errstate(over="ignore"):
        x = batch.column(KEY).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).copy()
        x ^= np.uint64((seed * 1000003 + tree + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2 ** 53


def _used(batch, task: Task, y: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rows with a label, outside the fold left out, drawn for this tree."""
    used = ~np.isnan(y)
    if task.left_out is not None:
        used &= batch.column(FOLD).to_numpy(zero_copy_only=False) != task.left_out
    if task.settings.row_share < 1:
        used &= draws < task.settings.row_share
    return np.flatnonzero(used)


def _slopes(task: Task, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the loss, in whole units."""
    if task.logistic:
        p = 1 / (1 + np.exp(-score))
        return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)
    return np.rint((score - y) / task.unit * UNIT), np.full(len(y), float(UNIT))


def _known(batch, models: list[Model]) -> np.ndarray | list[np.ndarray]:
    """Scores as written with the rows, one array per model; at first the models' bases."""
    if SCORES in batch.schema.names:
        return batch.column(SCORES).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T
    return [np.full(batch.num_rows, m.base) for m in models]


def _row_bins(batch, features: int) -> np.ndarray:
    return np.stack([batch.column(f"_b{i}").to_numpy(zero_copy_only=False) for i in range(features)])


def _histograms(data: DataFrame, models, pending, labels, growths, seed, tree) -> DataFrame:
    """Per job, slot and feature the rows, slopes and curvatures of all bins, one set per Spark task.

    Only rows in wanted leaves are scored and counted, and only for the features drawn.
    """
    features, width = len(models[0].features), BINS + 2
    work = [(j, g.tree, g.wanted, sorted(g.features)) for j, g in growths if g.wanted]

    def run(batches):
        sums = {j: np.zeros((3, features, len(nodes) * width), dtype=np.int64) for j, _, nodes, _ in work}
        for batch in _large(batches):
            bins, known, draws = _row_bins(batch, features), _known(batch, models), _draws(batch, seed, tree)
            ys, used = [_doubles(batch, f"_y{i}") for i in range(len(labels))], {}
            for j, grown, nodes, drawn in work:
                task = models[j].task
                label = labels.index(task.label)
                alike = label, task.left_out, task.settings.row_share
                if alike not in used:
                    used[alike] = _used(batch, task, ys[label], draws)
                slots = {node: slot for slot, node in enumerate(nodes)}
                found = list(grown.rows_at(bins, used[alike], nodes))
                rows = np.concatenate([at for _, at in found])
                start = np.repeat([slots[node] * width for node, _ in found], [len(at) for _, at in found])
                score = known[j][rows]
                for earlier in pending[j]:
                    score = score + earlier.score(bins, rows)
                g, h = _slopes(task, ys[label][rows], score)
                for f in drawn:
                    cell = start + bins[f][rows]
                    size = len(nodes) * width
                    counts = np.bincount(cell, minlength=size)
                    sums[j][0, f] += counts
                    sums[j][1, f] += np.bincount(cell, g, size).astype(np.int64)
                    # without a logistic loss all curvatures are one whole unit
                    sums[j][2, f] += (np.bincount(cell, h, size).astype(np.int64) if task.logistic
                                      else counts * UNIT)
        for j, total in sums.items():
            total = total.reshape(3, features, -1, width).transpose(2, 1, 0, 3)  # slot, feature, kind, bin
            slot, f = np.nonzero(total[:, :, 0].any(axis=2))
            cells = [total[at].tobytes() for at in zip(slot, f)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(f), j, np.int32)), pa.array(slot.astype(np.int32)),
                 pa.array(f.astype(np.int32)), pa.array(cells, pa.binary())],
                names=["job", "slot", "feature", "cells"])

    return data.mapInArrow(run, HISTOGRAMS)


def _worth(g: np.ndarray, h: np.ndarray, unit: float, l1: float, l2: float) -> np.ndarray:
    pull = np.maximum(np.abs(g * unit) - l1, 0.0)
    curve = h / UNIT + l2
    return np.divide(pull * pull, curve, out=np.zeros(len(pull)), where=curve != 0)


def _cut(sums: np.ndarray, task: Task) -> tuple:
    """Totals and the cut of the highest gain, ties to the lower bin; ``sums`` is 3 x bins."""
    s, unit = task.settings, (1.0 if task.logistic else task.unit) / UNIT
    used = np.flatnonzero(sums[0])
    ln, lg, lh = np.cumsum(sums[:, used], axis=1)
    n, g, h = (int(x[-1]) for x in (ln, lg, lh))
    dg, dh = lg.astype(np.float64), lh.astype(np.float64)
    whole = _worth(np.asarray([float(g)]), np.asarray([float(h)]), unit, s.l1, s.l2)
    gain = _worth(dg, dh, unit, s.l1, s.l2) + _worth(g - dg, h - dh, unit, s.l1, s.l2) - whole
    fits = ((ln >= s.least_rows) & (n - ln >= s.least_rows) & (n > ln) & (dh / UNIT >= LEAST_CURVATURE)
            & ((h - dh) / UNIT >= LEAST_CURVATURE) & (gain > 1e-12))
    if not fits.any():
        return n, g, h, None
    at = int(np.argmax(np.where(fits, gain, -np.inf)))
    return n, g, h, {"gain": float(gain[at]), "back": -int(used[at]),
                     "ln": int(ln[at]), "lg": int(lg[at]), "lh": int(lh[at])}


def _best_cuts(histograms: DataFrame, models: list[Model]) -> DataFrame:
    """Per job, slot and feature: totals and the best cut.  A task adds up and judges the leaves and
    features that the shuffle gives it, whose histograms are of fixed size."""
    tasks = [m.task for m in models]
    kinds = [pa.int32()] * 3 + [pa.int64()] * 3 + [pa.struct([
        ("gain", pa.float64()), ("back", pa.int32()), *[(c, pa.int64()) for c in ("ln", "lg", "lh")]])]
    names = ["job", "slot", "feature", "n", "g", "h", "best"]

    def run(batches):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            where = zip(*(batch.column(c).to_pylist() for c in names[:3]))
            for key, cells in zip(where, batch.column("cells")):
                part = np.frombuffer(cells.as_buffer(), np.int64).reshape(3, -1)
                sums[key] = sums[key] + part if key in sums else part
        rows = [(*key, *_cut(total, tasks[key[0]])) for key, total in sums.items()]
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return histograms.repartition("job", "slot", "feature").mapInArrow(run, CUTS)


# --- one tree, split by split --------------------------------------------------------

class Growth:
    """A tree in growth.  Splits that may be taken are tried ahead of time, see ``choose``."""

    def __init__(self, task: Task, features: list[int]):
        self.task, self.features = task, set(features)
        self.tree, self.level = Tree(), [0]
        self.sums: list[tuple[int, int, int] | None] = [None]
        self.best: dict[int, tuple | None] = {}
        self.wanted = [0]

    def take(self, found: list) -> None:
        """Cuts of the wanted nodes, as ``_best_cuts`` gives them."""
        for node in self.wanted:
            self.best[node] = None
        for r in found:
            node = self.wanted[r.slot]
            self.sums[node] = (r.n, r.g, r.h)
            if r.best is not None and r.feature in self.features:
                cut = (r.best.gain, -r.feature, r.best.back, (r.best.ln, r.best.lg, r.best.lh))
                if self.best[node] is None or cut > self.best[node]:
                    self.best[node] = cut
        self.wanted = []

    def choose(self) -> set[int]:
        """The nodes that are split, best first; children not yet counted become ``wanted``."""
        taken: set[int] = set()
        heap = [(-self.best[0][0], 0)] if self.best.get(0) else []
        while heap and len(taken) + 1 < self.task.settings.leaves:
            _, node = heapq.heappop(heap)
            taken.add(node)
            if self.tree.feature[node] < 0:
                self._split(node)
            for child in (self.tree.left[node], self.tree.right[node]):
                if self.best.get(child):
                    heapq.heappush(heap, (-self.best[child][0], child))
        return taken

    def _split(self, node: int) -> None:
        gain, feature, cut, left = self.best[node]
        right = tuple(a - b for a, b in zip(self.sums[node], left))
        self.tree.feature[node], self.tree.cut[node] = -feature, -cut
        self.tree.gain[node] = gain
        for name, sums in (("left", left), ("right", right)):
            child = len(self.tree.feature)
            getattr(self.tree, name)[node] = child
            for column, value in zip(("feature", "cut", "left", "right", "value", "rows", "gain"),
                                     (-1, 0, 0, 0, 0.0, 0, 0.0)):
                getattr(self.tree, column).append(value)
            self.sums.append(sums)
            self.level.append(self.level[node] + 1)
            s = self.task.settings
            if sums[0] >= 2 * max(s.least_rows, 1) and (s.depth < 0 or self.level[child] < s.depth):
                self.wanted.append(child)
            else:
                self.best[child] = None

    def finished(self) -> Tree:
        """The chosen splits alone, with leaf values."""
        taken, s, tree = self.choose(), self.task.settings, self.tree
        unit = (1.0 if self.task.logistic else self.task.unit) / UNIT
        for node, sums in enumerate(self.sums):
            n, g, h = sums or (0, 0, 0)
            slope, curve = g * unit, h / UNIT + s.l2
            pull = max(abs(slope) - s.l1, 0.0)
            tree.rows[node] = n
            tree.value[node] = (-pull if slope > 0 else pull) / curve * s.rate if curve > 0 else 0.0
            if node not in taken:
                tree.feature[node], tree.gain[node] = -1, 0.0
        return tree

    def leaves(self) -> int:
        return 1 + len(self.choose())


# --- fits ------------------------------------------------------------------------------

def _units(data: DataFrame, tasks: list[Task], labels: list[str]) -> list[Task]:
    """The tasks with a power of two that holds their label's largest size."""
    tops = data.agg(*[F.max(F.abs(F.col(f"_y{i}"))).alias(y) for i, y in enumerate(labels)]).first()
    return [replace(t, unit=2.0 ** ceil(log2(tops[t.label])) if tops[t.label] else 1.0) for t in tasks]


def _bases(data: DataFrame, tasks: list[Task], labels: list[str]) -> list[float]:
    """Log-odds or mean of each task's rows."""
    parts = []
    for i, t in enumerate(tasks):
        y = F.col(f"_y{labels.index(t.label)}")
        use = y.isNotNull() if t.left_out is None else y.isNotNull() & (F.col(FOLD) != t.left_out)
        parts += [F.count(F.when(use, y)).alias(f"n{i}"),
                  F.sum(F.when(use, F.round(y / t.unit * UNIT).cast("long"))).alias(f"s{i}")]
    row = data.agg(*parts).first()
    found = []
    for i, t in enumerate(tasks):
        n, mean = row[f"n{i}"], 0.0
        if n:
            mean = row[f"s{i}"] / n * t.unit / UNIT
        if t.logistic and n:
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            mean = log(mean / (1 - mean))
        found.append(mean)
    return found


def _with_scores(data: DataFrame, models: list[Model], pending: list[list[Tree]]) -> DataFrame:
    features = len(models[0].features)
    kept = [c for c in data.columns if c != SCORES]

    def run(batches):
        for batch in _large(batches):
            rows, bins, found = batch.num_rows, _row_bins(batch, features), []
            for score, trees in zip(_known(batch, models), pending):
                for tree in trees:
                    score = score + tree.score(bins)
                found.append(score)
            flat = np.stack(found, axis=1).ravel()
            ends = np.arange(rows + 1, dtype=np.int32) * len(models)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.ListArray.from_arrays(ends, pa.array(flat))],
                names=[*kept, SCORES])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.schema if f.name != SCORES)
    return data.mapInArrow(run, f"{schema}, {SCORES} array<double>")


def _grow(data: DataFrame, models: list[Model], labels: list[str], seed: int) -> None:
    """All trees of the models, a tree of each at a time."""
    pending: list[list[Tree]] = [[] for _ in models]
    names = range(len(models[0].features))
    for tree in range(max(m.task.settings.trees for m in models)):
        growths = []
        for j, m in enumerate(models):
            if tree < m.task.settings.trees:
                share = max(1, round(m.task.settings.feature_share * len(names)))
                drawn = random.Random(f"{seed} {tree}").sample(names, share)
                growths.append((j, Growth(m.task, drawn)))
        while any(g.wanted for _, g in growths):
            found: dict[int, list] = {}
            for r in _best_cuts(_histograms(data, models, pending, labels, growths, seed, tree),
                                models).collect():
                found.setdefault(r.job, []).append(r)
            for j, g in growths:
                if g.wanted:
                    g.take(found.get(j, []))
                    g.choose()
        for j, g in growths:
            grown = g.finished()
            models[j].trees.append(grown)
            pending[j].append(grown)
        if (tree + 1) % RESTAGE == 0:
            data = stage(_with_scores(data, models, pending), "scores")
            pending = [[] for _ in models]


def prepared(rows: DataFrame, key: str, features: list[str], labels: list[str],
             folds: int = fixed.SEARCH_FOLDS) -> tuple[DataFrame, list[list[float]]]:
    borders = quantile_borders(rows, features)
    return stage(binned(rows, key, features, labels, borders, folds), "binned"), borders


def _fitted(data, borders, features, labels, tasks, seed, together) -> list[Model]:
    models = []
    tasks = _units(data, tasks, labels)
    for start in range(0, len(tasks), together):
        some = tasks[start:start + together]
        group = [Model(t, list(features), borders, b) for t, b in zip(some, _bases(data, some, labels))]
        _grow(data, group, labels, seed)
        models += group
    return models


def fit(rows: DataFrame, key: str, tasks: list[Task], features=tuple(fixed.MODEL_FEATURES),
        seed: int = fixed.SEED, together: int = TOGETHER) -> list[Model]:
    """One model per task.  ``key`` decides folds and draws, so a rerun gives the same models."""
    labels = list(dict.fromkeys(t.label for t in tasks))
    with scope(rows.sparkSession):
        data, borders = prepared(rows, key, list(features), labels)
        return _fitted(data, borders, features, labels, tasks, seed, together)


def task_of(kind: str, settings: Settings = Settings(), left_out: int | None = None) -> Task:
    return Task(LABELS[kind], kind == "binary", settings, left_out)


def candidate_settings(grid: dict | None = None, samples: int = fixed.SEARCH_SAMPLES,
                       seed: int = fixed.SEED) -> list[Settings]:
    """A seeded sample of the grid, all of it when it is no larger."""
    grid = grid or fixed.LEAF_GRID
    size = prod(len(v) for v in grid.values())
    picked = range(size) if samples >= size else random.Random(seed).sample(range(size), samples)
    found = []
    for at in picked:
        values = {}
        for name, options in grid.items():
            at, i = divmod(at, len(options))
            values[name] = options[i]
        found.append(Settings(**values))
    return found


def _held_out(data: DataFrame, models: list[Model], labels: list[str]) -> dict[int, tuple]:
    """Per model (rows, a, b, c) on its fold: hits, false hits, misses; or the error in units."""
    features = len(models[0].features)

    def run(batches):
        sums = np.zeros((len(models), 4), dtype=np.int64)
        for batch in _large(batches):
            bins, fold = _row_bins(batch, features), batch.column(FOLD).to_numpy(zero_copy_only=False)
            for j, m in enumerate(models):
                y = _doubles(batch, f"_y{labels.index(m.task.label)}")
                rows = np.flatnonzero(~np.isnan(y) & (fold == m.task.left_out))
                score = m.base + sum(t.score(bins[:, rows]) for t in m.trees)
                score, y = np.broadcast_to(score, len(rows)), y[rows]
                if m.task.logistic:
                    said, is_one = score > 0, y == 1
                    counts = [(said & is_one).sum(), (said & ~is_one).sum(), (~said & is_one).sum()]
                else:
                    counts = [np.rint(np.abs(score - y) / m.task.unit * UNIT).sum(), 0, 0]
                sums[j] += np.asarray([len(rows), *counts], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(models), dtype=np.int32)), *[pa.array(sums[:, k].copy()) for k in range(4)]],
            names=["job", "n", "a", "b", "c"])

    found = data.mapInArrow(run, "job int, n long, a long, b long, c long").groupBy("job").agg(
        *[F.sum(c).alias(c) for c in ("n", "a", "b", "c")]).collect()
    return {r.job: (r.n, r.a, r.b, r.c) for r in found}


@dataclass
class Found:
    """Result of a search for one kind of model: scores are (settings, mean score, held-out rows)."""

    kind: str
    best: Settings
    model: Model
    scores: list[tuple[Settings, float, int]]


def search(rows: DataFrame, key: str, kinds=tuple(LABELS), sets: list[Settings] | None = None,
           folds: int = fixed.SEARCH_FOLDS, features=tuple(fixed.MODEL_FEATURES),
           seed: int = fixed.SEED, together: int = TOGETHER) -> dict[str, Found]:
    """Cross-validated search for several kinds at once; the best settings are fitted on all rows.

    Scores are F1 of class 1 for the classifier and the negative mean absolute error otherwise,
    averaged over the folds; ties go to the earlier set.
    """
    sets = sets or candidate_settings()
    labels = [LABELS[k] for k in kinds]
    with scope(rows.sparkSession):
        data, borders = prepared(rows, key, list(features), labels, folds)
        tasks = [task_of(k, s, fold) for k in kinds for s in sets for fold in range(folds)]
        fitted = _fitted(data, borders, features, labels, tasks, seed, together)
        held = {}
        for start in range(0, len(fitted), together):
            part = _held_out(data, fitted[start:start + together], labels)
            held |= {start + j: sums for j, sums in part.items()}
        results, at = {}, 0
        for kind in kinds:
            scores = []
            for s in sets:
                values, seen = [], 0
                for _ in range(folds):
                    n, a, b, c = held.get(at, (0, 0, 0, 0))
                    if kind == "binary":
                        values.append(2 * a / (2 * a + b + c) if a else 0.0)
                    else:
                        values.append(-a / n * fitted[at].task.unit / UNIT if n else 0.0)
                    seen, at = seen + n, at + 1
                scores.append((s, sum(values) / folds, seen))
            results[kind] = scores
        best = {k: max(v, key=lambda x: x[1])[0] for k, v in results.items()}
        final = _fitted(data, borders, features, labels, [task_of(k, best[k]) for k in kinds], seed, together)
    return {k: Found(k, best[k], m, results[k]) for k, m in zip(kinds, final)}


def predict(model: Model, rows: DataFrame, name: str) -> DataFrame:
    """Add the probability of class 1, or the predicted label."""
    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        bins = np.stack([_bins(c.to_numpy(dtype=np.float64, na_value=np.nan), b)
                         for c, b in zip(columns, model.borders)])
        score = np.full(bins.shape[1], model.base)
        for tree in model.trees:
            score = score + tree.score(bins)
        return pd.Series(1 / (1 + np.exp(-score)) if model.task.logistic else score)

    return rows.withColumn(name, scored(*[F.col(f).cast("double") for f in model.features]))


def constant(model: Model) -> float:
    """What the model would say without its trees."""
    return 1 / (1 + exp(-model.base)) if model.task.logistic else model.base
