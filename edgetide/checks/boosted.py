"""Checks of the leaf-wise reuse models: what a fit saw, how good it is, and the search."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.models import _table
from edgetide.checks.views import AS_OF, snapshot
from edgetide.operators import boosting, snapshot as snapshots
from edgetide.operators.boosting import Settings, task_of
from edgetide.operators.models import LABELS

c = F.col
SETTINGS = Settings(trees=6, leaves=15, rate=0.2, l1=0.1, l2=1.0)
#: values of the full grid; trees and sets are fewer, so that a check ends soon
GRID = {"trees": [3], "leaves": [15, 31], "least_rows": [20, 50], "rate": [0.1, 0.2],
        "row_share": [0.8], "feature_share": [0.8], "l1": [0, 0.5], "l2": [0.1, 1.0]}
SAMPLES = 3


@lru_cache(maxsize=4)
def _train(spark, d):
    return _table(spark, d).filter(c("split") == "train")


@lru_cache(maxsize=4)
def _fits(spark, d):
    tasks = [task_of(kind, SETTINGS) for kind in LABELS]
    return dict(zip(LABELS, boosting.fit(_train(spark, d), "event_id", tasks)))


@lru_cache(maxsize=4)
def _search(spark, d):
    return boosting.search(_train(spark, d), "event_id",
                           sets=boosting.candidate_settings(GRID, SAMPLES))


_BUCKET = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"
_KINDS = "(VALUES ('binary'), ('distance'), ('reuse')) AS k(model)"


@query("leaf_wise_trees_m14_m15_m16", f"""SELECT model, CAST(tree AS INTEGER) AS tree, rows, true AS within
    FROM (SELECT count(*) AS rows FROM trace WHERE {_BUCKET} < 64), {_KINDS}, range({SETTINGS.trees}) AS t(tree)""")
def leaf_wise_trees(spark, d):
    """Each tree's leaves hold every train row once and are no more than allowed."""
    found = []
    for kind, model in _fits(spark, d).items():
        for i, tree in enumerate(model.trees):
            leaves, open_ = [], [0]
            while open_:
                node = open_.pop()
                if tree.feature[node] < 0:
                    leaves.append(tree.rows[node])
                else:
                    open_ += [tree.left[node], tree.right[node]]
            within = len(leaves) <= SETTINGS.leaves and (
                len(leaves) == 1 or min(leaves) >= SETTINGS.least_rows)
            found.append((kind, i, sum(leaves), within))
    return spark.createDataFrame(found, "model string, tree int, rows long, within boolean")


@query("leaf_wise_quality_m14_m15_m16")
def leaf_wise_quality(spark, d):
    """Mean squared error on the test rows, beside that of the best constant of the train rows."""
    fits, frame = _fits(spark, d), _table(spark, d).filter(c("split") == "test")
    for kind, model in fits.items():
        frame = boosting.predict(model, frame, f"_{kind}")
    parts = []
    for kind, model in fits.items():
        y = c(LABELS[kind]).cast("double")
        error, plain = (F.avg((y - p) ** 2) for p in (c(f"_{kind}"), F.lit(boosting.constant(model))))
        parts.append(F.struct(F.lit(kind).alias("model"), F.count(y).alias("rows"),
                              error.alias("error"), plain.alias("constant_error")))
    return frame.agg(F.array(*parts).alias("m")).select(F.explode("m").alias("m")).select("m.*")


@query("leaf_wise_search_rows_m18", f"""SELECT model, CAST(nr AS INTEGER) AS nr, rows AS held_out
    FROM (SELECT count(*) AS rows FROM trace WHERE {_BUCKET} < 64), {_KINDS}, range({SAMPLES}) AS t(nr)""")
def leaf_wise_search_rows(spark, d):
    """Every train row is judged once by each parameter set, in the fold its fit did not see."""
    found = [(kind, i, n) for kind, f in _search(spark, d).items()
             for i, (_, _, n) in enumerate(f.scores)]
    return spark.createDataFrame(found, "model string, nr int, held_out long")


@query("leaf_wise_search_m18")
def leaf_wise_search(spark, d):
    """Mean score of each parameter set over three folds, for the three models."""
    found = [(kind, str(s), score, s == f.best) for kind, f in _search(spark, d).items()
             for s, score, _ in f.scores]
    return spark.createDataFrame(found, "model string, params string, score double, best boolean")


@query("leaf_wise_importance_k11", f"""SELECT model, CAST(9 AS BIGINT) AS features, true AS whole FROM {_KINDS}""")
def leaf_wise_importance(spark, d):
    """All features are listed, and their shares of the gain add up to one."""
    rows = [(kind, name, share) for kind, m in _fits(spark, d).items() for name, share in m.importance()]
    return spark.createDataFrame(rows, "model string, feature string, share double").groupBy("model").agg(
        F.count_distinct("feature").alias("features"), (F.abs(F.sum("share") - 1) < 1e-9).alias("whole"))


@query("leaf_wise_predictions_m19", """SELECT region, file_id, true AS in_range, true AS same FROM snapshot""")
def leaf_wise_predictions(spark, d):
    """Predictions for the snapshot: p within 0 to 1, and the same from a model written and read."""
    features = snapshots.serving_features(snapshot(spark, d), AS_OF)
    frame = snapshots.model_row(features, keep=["region", "file_id"])
    for kind, model in _fits(spark, d).items():
        frame = boosting.predict(model, frame, kind)
        frame = boosting.predict(boosting.Model.from_json(model.to_json()), frame, f"{kind}_read")
    same = (c("binary") == c("binary_read")) & (c("distance") == c("distance_read")) & (
        c("reuse") == c("reuse_read"))
    return frame.select("region", "file_id", c("binary").between(0, 1).alias("in_range"), same.alias("same"))
