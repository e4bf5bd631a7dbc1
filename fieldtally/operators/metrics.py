"""Model scores as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_ratio


def _scores(tp: Column, fp: Column, fn: Column, tn: Column, digits: int) -> dict[str, Column]:
    return {
        "accuracy": F.round(safe_ratio(tp + tn, tp + fp + fn + tn), digits),
        "precision": F.round(safe_ratio(tp, tp + fp), digits),
        "recall": F.round(safe_ratio(tp, tp + fn), digits),
        "f1": F.round(safe_ratio(2 * tp, 2 * tp + fp + fn), digits),
    }


def binary_counts(df: DataFrame, label: str, prediction: str, positive=1, by: Sequence[str] = ()) -> DataFrame:
    hit, said = F.col(label) == positive, F.col(prediction) == positive
    return df.groupBy(*by).agg(
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"),
        F.count_if(~hit & ~said).alias("tn"),
    )


def scores_from_counts(counts: DataFrame, digits: int = 6) -> DataFrame:
    return counts.withColumns(_scores(*[F.col(c) for c in ("tp", "fp", "fn", "tn")], digits))


def classification_metrics(
    df: DataFrame, label: str, prediction: str, positive=1, by: Sequence[str] = (), digits: int = 6
) -> DataFrame:
    return scores_from_counts(binary_counts(df, label, prediction, positive, by), digits)


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(df: DataFrame, label: str, prediction: str, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion matrix."""
    cells = confusion_matrix(df, label, prediction)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").cast("string").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    return sums.select(
        "class",
        F.round(safe_ratio("hit", "said"), digits).alias("precision"),
        F.round(safe_ratio("hit", "support"), digits).alias("recall"),
        F.round(safe_ratio(2 * F.col("hit"), F.col("said") + F.col("support")), digits).alias("f1"),
        "support",
    )


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """R2, MSE and MAE in one aggregate."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction).cast("double")
    # sum of squared deviations from the mean, without a second pass
    spread = F.var_pop(y) * F.count(y)
    return df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(1 - safe_ratio(F.sum(e * e), spread), digits).alias("r2"),
        F.round(F.avg(e * e), digits).alias("mse"),
        F.round(F.avg(F.abs(e)), digits).alias("mae"),
    )
