"""Leaf-wise trees against a plain numpy booster that splits one leaf at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.operators import boosting
from edgetide.operators.boosting import UNIT, Model, Settings, Task

FEATURES = ["a", "b", "c"]


def made(rows=900, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=rows), rng.integers(0, 6, rows).astype(float), rng.exponential(size=rows)
    y = 3 * (a > 0.3) * (b > 2) + c + rng.normal(scale=0.1, size=rows)
    return [(i, float(a[i]), None if i % 17 == 0 else float(b[i]), float(c[i]), float(y[i]), int(y[i] > 2))
            for i in range(rows)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), "id long, a double, b double, c double, y double, one int")


def plain_trees(model, data):
    """(leaf rows sorted, scores) per tree; every split looks at all leaves afresh."""
    task, s = model.task, model.task.settings
    x = np.array([[np.nan if r[1 + f] is None else r[1 + f] for r in data] for f in range(3)])
    y = np.array([r[5] if task.logistic else r[4] for r in data], dtype=float)
    bins = np.stack([boosting._bins(x[f], model.borders[f]) for f in range(3)])
    unit = (1.0 if task.logistic else task.unit) / UNIT
    score = np.full(len(y), model.base)

    def worth(g, h):
        return max(abs(g * unit) - s.l1, 0) ** 2 / (h / UNIT + s.l2)

    def best(at, g, h):
        found = None
        for f in range(3):
            for cut in np.unique(bins[f, at]):
                left, right = at[bins[f, at] <= cut], at[bins[f, at] > cut]
                if len(left) < s.least_rows or len(right) < s.least_rows:
                    continue
                gain = (worth(g[left].sum(), h[left].sum()) + worth(g[right].sum(), h[right].sum())
                        - worth(g[at].sum(), h[at].sum()))
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left, right)
        return found

    for _ in range(s.trees):
        g, h = boosting._slopes(task, y, score)
        leaves = [np.arange(len(y))]
        cuts = [best(leaves[0], g, h)]
        while len(leaves) < s.leaves and any(cuts):
            i = max(range(len(leaves)), key=lambda k: cuts[k][0] if cuts[k] else -1)
            _, left, right = cuts[i]
            leaves[i:i + 1], cuts[i:i + 1] = [left, right], [best(left, g, h), best(right, g, h)]
        for at in leaves:
            slope = g[at].sum() * unit
            pull = max(abs(slope) - s.l1, 0)
            score[at] += (-pull if slope > 0 else pull) / (h[at].sum() / UNIT + s.l2) * s.rate
        yield sorted(len(at) for at in leaves), score.copy()


@pytest.mark.parametrize("task", [
    Task("y", False, Settings(trees=2, leaves=9, rate=0.3)),
    Task("y", False, Settings(trees=5, leaves=5, rate=0.3, l1=0.7, l2=2.0)),
    Task("one", True, Settings(trees=2, leaves=12, rate=0.2, least_rows=5, l2=0.5)),
], ids=["plain", "penalties and written scores", "logistic"])
def test_equals_one_split_at_a_time(rows, task, monkeypatch):
    monkeypatch.setattr(boosting, "RESTAGE", 2)
    data = made()
    model, = boosting.fit(rows, "id", [task], FEATURES)
    for tree, (sizes, score) in zip(model.trees, plain_trees(model, data)):
        assert sorted(n for n, f in zip(tree.rows, _reached(tree)) if f) == sizes
    said = {r.id: r.p for r in boosting.predict(model, rows, "p").collect()}
    wanted = 1 / (1 + np.exp(-score)) if task.logistic else score
    assert np.allclose([said[i] for i in range(len(data))], wanted, atol=1e-6)


def _reached(tree):
    """Whether each node is a leaf that rows can reach."""
    found, open_ = [False] * len(tree.feature), [0]
    while open_:
        node = open_.pop()
        if tree.feature[node] < 0:
            found[node] = True
        else:
            open_ += [tree.left[node], tree.right[node]]
    return found


def test_same_models_from_other_partitions(rows):
    tasks = [Task("y", False, Settings(trees=2, leaves=8, row_share=0.7, feature_share=0.7)),
             Task("one", True, Settings(trees=2, leaves=8, depth=2), left_out=1)]
    first = [m.to_json() for m in boosting.fit(rows, "id", tasks, FEATURES)]
    again = boosting.fit(rows.repartition(5, "c"), "id", tasks, FEATURES, together=1)
    assert [m.to_json() for m in again] == first
    assert [Model.from_json(j).to_json() for j in first] == first
    assert max(len(t.feature) for t in again[1].trees) <= 7
    assert abs(sum(share for _, share in again[0].importance()) - 1) < 1e-9


def test_search_scores_rows_that_were_left_out(rows, monkeypatch):
    monkeypatch.setitem(boosting.LABELS, "distance", "y")
    monkeypatch.setitem(boosting.LABELS, "binary", "one")
    sets = [Settings(trees=1, leaves=2, rate=0.1), Settings(trees=3, leaves=8, rate=0.5)]
    found = boosting.search(rows, "id", ("binary", "distance"), sets, features=FEATURES)
    for kind in found:
        assert found[kind].best == sets[1] and [n for _, _, n in found[kind].scores] == [900, 900]
    apart, = boosting.fit(rows, "id", [Task("y", False, sets[1], left_out=0)], FEATURES)
    fold = boosting.hash_bucket(F.concat(F.lit("fold"), F.col("id").cast("string")), 3)
    assert apart.trees[0].rows[0] == rows.filter(fold != 0).count()


def test_odd_rows(spark):
    schema = "id long, a double, b double, c double, y double, one int"
    task = Task("y", False, Settings(trees=2, least_rows=1))
    empty, = boosting.fit(spark.createDataFrame([], schema), "id", [task], FEATURES)
    assert empty.base == 0 and [t.value for t in empty.trees] == [[0.0], [0.0]]
    odd = spark.createDataFrame([(1, None, float("nan"), 1.0, 5.0, 1), (1, None, 2.0, 1.0, 5.0, 1),
                                 (2, 1.0, None, 1.0, None, None), (None, 3.0, 1.0, None, 1.0, 0)], schema)
    model, = boosting.fit(odd, "id", [task], FEATURES)
    assert model.trees[0].rows[0] == 3 and abs(model.base - 11 / 3) < 1e-5
    assert boosting.predict(model, odd, "p").filter("p is null or isnan(p)").count() == 0


def test_a_task_sends_a_row_per_leaf_and_drawn_feature(rows):
    task = Task("y", False, Settings(trees=1))
    data, borders = boosting.prepared(rows.coalesce(2), "id", FEATURES, ["y"])
    model = Model(task, FEATURES, borders)
    sent = boosting._histograms(data, [model], [[]], ["y"], [(0, boosting.Growth(task, [0, 2]))], 1, 0)
    assert {r.feature for r in sent.collect()} == {0, 2}
    assert sent.count() <= 2 * data.rdd.getNumPartitions()


def test_only_rows_of_wanted_leaves_are_followed():
    tree = boosting.Tree(feature=[0, 1, -1, -1, -1], cut=[3, 5, 0, 0, 0], left=[1, 3, 0, 0, 0], right=[2, 4, 0, 0, 0],
                         value=[0.0, 0.0, 1.0, 2.0, 3.0], rows=[0] * 5, gain=[0.0] * 5)
    bins = np.array([[1, 9, 2, 3, 4], [5, 0, 6, 7, 1]])
    assert {n: list(at) for n, at in tree.rows_at(bins, np.array([0, 2, 4]), [4])} == {4: [2]}
    assert list(tree.score(bins)) == [2, 1, 3, 3, 1] and list(tree.score(bins, np.array([4, 3]))) == [1, 3]
