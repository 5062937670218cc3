"""Metrics, each as a small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.plans.prefix import running_total


def rmse(rows: DataFrame, label: str = "rating", prediction: str = "pred_rating") -> DataFrame:
    """Root mean squared error."""
    error = F.col(label) - F.col(prediction)
    return rows.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def accuracy(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose predicted class is the label."""
    hit = (F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")
    return rows.agg(F.avg(hit).alias("accuracy"))


def auc(rows: DataFrame, score: str = "p1", label: str = "label") -> DataFrame:
    """Exact area under the ROC curve; tied scores count one half.

    The chance that a positive outranks a negative: each distinct score adds its
    positives times the negatives below it, plus half of those beside it. Null
    when a class is missing; a null score or label is an error.
    """

    def present(column: str, dtype: str) -> Column:
        missing = F.raise_error(F.lit(f"{column} is missing")).cast(dtype)
        return F.coalesce(F.col(column).cast(dtype), missing)

    positive = present(label, "bigint")
    per_score = rows.groupBy(present(score, "double").alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    ranked = running_total(per_score, "score", "neg", "below")
    wins = F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2)
    return ranked.agg(
        F.try_divide(
            F.sum(wins), F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("auc")
    )
