"""Quality of predictions: classification, ranking and regression metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.operators.ordered import value_counts_in_order


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                    F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def _rate(part, whole):
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def classification(rows: DataFrame, label: str = "label", prediction: str = "prediction"
                   ) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion(rows, label, prediction).select(
        _rate(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _rate(tp, tp + fp).alias("precision"), _rate(tp, tp + fn).alias("recall"),
        _rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def per_class(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class. Counted per (label, prediction) first."""
    pairs = rows.groupBy(label, prediction).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint")
                 .alias("predicted"), F.when(F.col(label) == F.col(prediction), F.col("n"))
                 .otherwise(0).alias("right")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("right")),
    )).alias("s")).select("s.*")
    return sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("right").alias("right"),
    ).select("class", _rate(F.col("right"), F.col("predicted")).alias("precision"),
             _rate(F.col("right"), F.col("support")).alias("recall"),
             _rate(2 * F.col("right"), F.col("predicted") + F.col("support")).alias("f1"),
             "support")


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score",
            blocks: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows are counted per distinct score, so equal scores are one row in the order.
    """
    positive = (F.col(label) == 1).cast("bigint")
    ordered = value_counts_in_order(rows, score, blocks, pos=positive, neg=1 - positive)
    wins = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0)
    return ordered.agg(F.try_divide(
        F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def regression(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    error = F.col(label) - F.col(prediction)
    sums = rows.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
                    F.var_pop(label).alias("_var"))
    return sums.select("mse", "mae", F.sqrt("mse").alias("rmse"),
                       (1 - F.try_divide(F.col("mse"), F.col("_var"))).alias("r2"))
