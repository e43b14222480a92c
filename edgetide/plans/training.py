"""From accesses to trained reuse models and their results."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths
from edgetide.operators import cleaning, models, snapshot as snapshots, trace
from edgetide.staging import stage


def training_table(accesses: DataFrame, key: str, window: int = fixed.LOOK_AHEAD,
                   capacity: int = fixed.CACHE_OBJECTS, blocks: int | None = None) -> DataFrame:
    """Cleaned accesses with labels, features and their split, written once.

    The needed columns of usable accesses are written first: counting, range sampling
    and the range shuffle each read them, and none should parse the log again.  History
    and labels share one shuffle by (object, block).
    """
    wanted = [c for c in (key, "ts", "file_id", "file_type", "size", "status", "user_agent")
              if c in accesses.columns]
    usable = stage(cleaning.typed(cleaning.usable(accesses.select(*wanted))).select(
        key, "ts", "file_id", "type", "size", "log_file_size"), "usable")
    clean = cleaning.of_frequent_objects(usable, key)
    base = stage(trace.with_lru(trace.positioned(clean, key, blocks=blocks), capacity), "lru")
    rows = trace.look_ahead(trace.history(base), window, base=base)
    rows = rows.withColumn("type_encoded", paths.class_ordinal(F.col("type")))
    return stage(models.with_split(rows, key), "training")


@dataclass
class Bundle:
    """Three models and their results (model, kind, name, value) as a small table."""

    models: dict[str, PipelineModel]
    results: DataFrame

    def save(self, path: str) -> None:
        for kind, model in self.models.items():
            model.write().overwrite().save(f"{path}/{kind}")
        self.results.write.mode("overwrite").json(f"{path}/results")


RESULTS = "model STRING, kind STRING, name STRING, value STRING"


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    found = {kind: PipelineModel.load(f"{path}/{kind}") for kind in models.LABELS}
    return Bundle(found, spark.read.schema(RESULTS).json(f"{path}/results"))


def train(table: DataFrame, key: str, tune: bool = True, params: dict | None = None,
          **search_options) -> Bundle:
    """Fit the three models on the train rows and measure them on the test rows."""
    spark = table.sparkSession
    rows_train = table.filter(F.col("split") == "train")
    rows_test = table.filter(F.col("split") == "test")
    fitted, described, measured = {}, [], None
    for kind in models.LABELS:
        if tune:
            model, best, score, _ = models.search(kind, rows_train, key, **search_options)
            described += [(kind, "best_params", n, json.dumps(v)) for n, v in best.items()]
            described.append((kind, "best_cv_score", "best_cv_score", repr(float(score))))
        else:
            model = models.fit(kind, rows_train, **(params or {}))
            described += [(kind, "best_params", n, json.dumps(v)) for n, v in models.fitted_params(model).items()]
        fitted[kind] = model
        metrics = models.test_metrics(kind, model, rows_test)
        measured = metrics if measured is None else measured.unionByName(metrics)
    importance = models.feature_importance(fitted["binary"], spark)
    statistics = trace.training_statistics(table)
    sizes = table.groupBy("split").agg(F.count("*").alias("n"))
    as_rows = [
        spark.createDataFrame(described, RESULTS) if described else spark.createDataFrame([], RESULTS),
        measured.select("model", F.lit("test_metrics").alias("kind"), F.col("metric").alias("name"),
                        F.col("value").cast("string").alias("value")),
        importance.select(F.lit("binary").alias("model"), F.lit("feature_importance").alias("kind"),
                          F.col("feature").alias("name"),
                          F.col("importance").cast("string").alias("value")),
        sizes.select(F.lit("all").alias("model"), F.lit("data_splits").alias("kind"),
                     F.col("split").alias("name"), F.col("n").cast("string").alias("value")),
        statistics.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
            for n in statistics.columns])).alias("s")).select(
            F.lit("all").alias("model"), F.lit("training_stats").alias("kind"), "s.name", "s.value"),
    ]
    results = as_rows[0]
    for part in as_rows[1:]:
        results = results.unionByName(part)
    return Bundle(fitted, stage(results, "results"))


def model_listing(bundle: Bundle) -> DataFrame:
    """(model, kind, name, value): parameters, search score and test metrics per model."""
    return bundle.results.filter(
        F.col("kind").isin("best_params", "best_cv_score", "test_metrics"))


def predict_snapshot(bundle: Bundle, snapshot: DataFrame, as_of) -> DataFrame:
    """Snapshot rows with their serving features and the three predictions."""
    features = snapshots.serving_features(snapshot, as_of)
    keep = [c for c in features.columns if c not in fixed.MODEL_FEATURES]
    return models.predict_all(bundle.models, snapshots.model_row(features, keep=keep))
