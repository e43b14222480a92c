"""Reuse models on MLlib: split, fit, search, predict, describe."""

from __future__ import annotations

import itertools
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed
from edgetide.operators import evaluation

#: model name -> label column
LABELS = {"binary": "will_be_accessed_in_n", "distance": "next_access_distance",
          "reuse": "future_reuse_prob"}


def hash_bucket(key: Column, buckets: int) -> Column:
    """A repeatable bucket from the first 32 bits of the key's md5."""
    bits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10)
    return F.pmod(bits.cast("bigint"), F.lit(buckets)).cast("int")


def with_split(rows: DataFrame, key: str) -> DataFrame:
    """train / val / test in shares 64 / 16 / 20, decided by the row's key alone."""
    bucket = hash_bucket(F.col(key), 100)
    return rows.withColumn("split", F.when(bucket < 64, "train").when(bucket < 80, "val")
                           .otherwise("test"))


def estimator(kind: str, **params):
    label = LABELS[kind]
    shared = {"labelCol": label, "featuresCol": "features", "seed": fixed.SEED, **params}
    return GBTClassifier(**shared) if kind == "binary" else GBTRegressor(**shared)


def model_pipeline(kind: str, features=tuple(fixed.MODEL_FEATURES), **params) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, estimator(kind, **params)])


def fit(kind: str, train: DataFrame, features=tuple(fixed.MODEL_FEATURES), **params
        ) -> PipelineModel:
    columns = [c for c in dict.fromkeys([*features, LABELS[kind]])]
    return model_pipeline(kind, features, **params).fit(
        train.select(*columns).withColumn(LABELS[kind], F.col(LABELS[kind]).cast("double")))


def fitted_params(model: PipelineModel) -> dict:
    """What a model was fitted with, of all parameters a search may set."""
    return {n: model.stages[-1].getOrDefault(n) for n in fixed.FULL_GRID}


def candidate_params(stage_, quick: bool = True, method: str = "random",
                     samples: int = fixed.SEARCH_SAMPLES, grid: dict | None = None,
                     seed: int = fixed.SEED) -> list[dict]:
    """Param maps of the full grid, or a seeded sample of it."""
    grid = grid or (fixed.QUICK_GRID if quick else fixed.FULL_GRID)
    names = list(grid)
    everything = list(itertools.product(*grid.values()))
    if method == "random" and samples < len(everything):
        everything = random.Random(seed).sample(everything, samples)
    return [{stage_.getParam(n): v for n, v in zip(names, values)} for values in everything]


def search(kind: str, train: DataFrame, key: str, features=tuple(fixed.MODEL_FEATURES),
           quick: bool = True, method: str = "random", samples: int = fixed.SEARCH_SAMPLES,
           grid: dict | None = None, folds: int = fixed.SEARCH_FOLDS, parallelism: int = 4):
    """Cross-validated search; returns (best model, best params, best score, all scores).

    Scores are F1 for the classifier and the negative mean absolute error otherwise.
    Folds come from the row key, so a rerun sees the same folds.
    """
    label = LABELS[kind]
    rows = (train.select(key, *dict.fromkeys([*features, label]))
            .withColumn(label, F.col(label).cast("double"))
            .withColumn("fold", hash_bucket(F.concat(F.lit("fold"), F.col(key)), folds)))
    pipe = model_pipeline(kind, features)
    params = candidate_params(pipe.getStages()[-1], quick, method, samples, grid)
    judge = (MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel",
                                               metricLabel=1.0)
             if kind == "binary" else RegressionEvaluator(labelCol=label, metricName="mae"))
    found = CrossValidator(estimator=pipe, estimatorParamMaps=params, evaluator=judge,
                           numFolds=folds, foldCol="fold", parallelism=parallelism).fit(rows)
    sign = 1.0 if kind == "binary" else -1.0
    means = [sign * m for m in found.avgMetrics]
    best = max(range(len(means)), key=means.__getitem__)
    named = [{p.name: v for p, v in m.items()} for m in params]
    return found.bestModel, named[best], means[best], list(zip(named, means))


def predict(kind: str, model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add p, distance or reuse. The classifier gives the probability of class 1."""
    name = {"binary": "p", "distance": "distance", "reuse": "reuse"}[kind]
    scored = model.transform(rows)
    value = vector_to_array("probability")[1] if kind == "binary" else F.col("prediction")
    made = [c for c in ("features", "rawPrediction", "probability", "prediction")
            if c in scored.columns]
    return scored.withColumn(name, value).drop(*made)


def predict_all(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    for kind in LABELS:
        rows = predict(kind, models[kind], rows)
    return rows


def test_metrics(kind: str, model: PipelineModel, rows: DataFrame) -> DataFrame:
    """One row per metric of the model on held-out rows: (model, metric, value)."""
    label = LABELS[kind]
    scored = model.transform(rows)
    if kind == "binary":
        scored = scored.select(F.col(label).alias("label"), "prediction",
                               vector_to_array("probability")[1].alias("score"))
        wide = evaluation.classification(scored).withColumn(
            "auc", evaluation.roc_auc(scored).scalar())
    else:
        wide = evaluation.regression(scored.select(F.col(label).alias("label"), "prediction"))
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in wide.columns]
    return (wide.select(F.explode(F.array(*pairs)).alias("m"))
            .select(F.lit(kind).alias("model"), "m.metric", "m.value"))


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, importance), highest first. One row per feature of the model."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    return (spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))
