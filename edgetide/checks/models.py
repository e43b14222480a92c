"""Checks of splits, quality metrics and the reuse models."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.eviction import cut_sql
from edgetide.checks.views import AS_OF, LIMIT_MB, accesses, labelled_scores, predictions, snapshot
from edgetide.operators import evaluation, eviction, models, snapshot as snapshots
from edgetide.plans import evict, training
from edgetide.staging import new_path

c = F.col


@lru_cache(maxsize=4)
def _table(spark, d):
    return training.training_table(accesses(spark, d), "event_id", capacity=20)


@lru_cache(maxsize=4)
def _bundle(spark, d):
    return training.train(_table(spark, d), "event_id", tune=False)


@query("split_sizes_a6_m17", """SELECT split, count(*) AS rows FROM (SELECT CASE WHEN b < 64 THEN 'train'
    WHEN b < 80 THEN 'val' ELSE 'test' END AS split FROM (SELECT
      CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS b FROM trace))
    GROUP BY ALL""")
def split_sizes(spark, d):
    return _table(spark, d).groupBy("split").agg(F.count("*").alias("rows"))


_C = """WITH c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM labelled_scores)"""


@query("classification_metrics_a23", _C + """SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
    round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def classification_metrics(spark, d):
    m = evaluation.classification(labelled_scores(spark, d))
    return m.select(*[F.round(n, 6).alias(n) for n in m.columns])


@query("per_class_report_a24", _C + """SELECT CAST(1 AS INTEGER) AS class, round(tp / (tp + fp), 6) AS precision,
    round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS support FROM c
    UNION ALL SELECT 0, round(tn / (tn + fn), 6), round(tn / (tn + fp), 6),
    round(2 * tn / (2 * tn + fp + fn), 6), tn + fp FROM c""")
def per_class_report(spark, d):
    return evaluation.per_class(labelled_scores(spark, d)).select(
        "class", *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")], "support")


@query("roc_auc_a25", """WITH r AS (SELECT label, rank() OVER (ORDER BY score)
      + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM labelled_scores)
    SELECT round((sum(r) FILTER (label = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc
    FROM r, (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0
      FROM labelled_scores) GROUP BY n1, n0""")
def roc_auc(spark, d):
    return evaluation.roc_auc(labelled_scores(spark, d)).select(F.round("auc", 6).alias("auc"))


@query("regression_metrics_a26", """SELECT round(avg((label - score) ** 2), 6) AS mse,
    round(avg(abs(label - score)), 6) AS mae, round(sqrt(avg((label - score) ** 2)), 6) AS rmse,
    round(1 - avg((label - score) ** 2) / var_pop(label), 6) AS r2 FROM labelled_scores""")
def regression_metrics(spark, d):
    m = evaluation.regression(labelled_scores(spark, d), prediction="score")
    return m.select(*[F.round(n, 6).alias(n) for n in m.columns])


def _model_metrics(spark, d, kind):
    rows = _table(spark, d).filter(c("split") == "test")
    return models.test_metrics(kind, _bundle(spark, d).models[kind], rows)


@query("reuse_classifier_m14")
def reuse_classifier(spark, d):
    return _model_metrics(spark, d, "binary")


@query("distance_regressor_m15")
def distance_regressor(spark, d):
    return _model_metrics(spark, d, "distance")


@query("reuse_regressor_m16")
def reuse_regressor(spark, d):
    return _model_metrics(spark, d, "reuse")


@query("parameter_search_m18")
def parameter_search(spark, d):
    """Mean score per parameter set of a small seeded random search."""
    train = _table(spark, d).filter(c("split") == "train")
    grid = {"maxIter": [1, 2], "maxDepth": [2, 3], "stepSize": [0.1, 0.2]}
    _, _, _, scores = models.search("distance", train, "event_id", grid=grid, samples=2, folds=2)
    rows = [(str(sorted(p.items())), float(s)) for p, s in scores]
    return spark.createDataFrame(rows, "params string, score double")


@query("snapshot_predictions_m19")
def snapshot_predictions(spark, d):
    found = training.predict_snapshot(_bundle(spark, d), snapshot(spark, d), AS_OF)
    return found.select("region", "file_id", "p", "distance", "reuse")


@query("learned_eviction_plan_m11")
def learned_eviction_plan(spark, d):
    """The plan from trained models, end to end."""
    found = training.predict_snapshot(_bundle(spark, d), snapshot(spark, d), AS_OF)
    return evict.plan_lrb(found, LIMIT_MB, AS_OF).evicted.select("region", "file_id", "score", "rank")


@query("model_bundle_round_trip_s13", "SELECT region, file_id, true AS same FROM snapshot")
def model_bundle_round_trip(spark, d):
    """Predictions of saved and loaded models beside those of the originals."""
    path = new_path(spark, "bundle")
    _bundle(spark, d).save(path)
    keys = ["region", "file_id"]
    before = training.predict_snapshot(_bundle(spark, d), snapshot(spark, d), AS_OF)
    after = training.predict_snapshot(training.load_bundle(spark, path), snapshot(spark, d), AS_OF)
    return before.select(*keys, c("p").alias("p_before")).join(
        after.select(*keys, c("p").alias("p_after")), keys).select(
        *keys, (c("p_before") == c("p_after")).alias("same"))


@query("model_listing_m21")
def model_listing(spark, d):
    return training.model_listing(_bundle(spark, d))


@query("feature_importance_k11")
def feature_importance(spark, d):
    return models.feature_importance(_bundle(spark, d).models["binary"], spark)


_SHARE = "greatest(distance, 0) / max(greatest(distance, 0)) OVER (PARTITION BY region)"


@query("alternative_feature_plan_m5_m11", cut_sql(
    f"((1 - p) * 0.4 + {_SHARE} * 0.4 + (1 - least(greatest(reuse, 0), 1)) * 0.2)", "predictions") + """
    SELECT region, file_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM evicted""")
def alternative_feature_plan(spark, d):
    """Belady plan over the older feature set and type whitelist."""
    older = snapshots.alternative_features(predictions(spark, d), AS_OF)
    plan = evict.plan_belady(older, "lrb", LIMIT_MB, AS_OF)
    return plan.evicted.select("region", "file_id", F.round("score", 6).alias("score"),
                               F.col("rank").cast("int").alias("rank"))
