"""Gaussian naive Bayes from one grouped aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class GaussianBayes:
    features: list[str]
    classes: list
    prior: list[float]
    mean: list[list[float]]
    variance: list[list[float]]

    def log_likelihood(self, i: int) -> Column:
        total = F.lit(math.log(self.prior[i]))
        for f, m, v in zip(self.features, self.mean[i], self.variance[i]):
            total = total + F.lit(-0.5 * math.log(2 * math.pi * v)) - (F.col(f) - m) * (F.col(f) - m) / F.lit(2 * v)
        return total

    def apply(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        ballots = F.array(
            *[F.struct(self.log_likelihood(i).alias("w"), F.lit(-i).alias("order"), F.lit(c).alias("c")) for i, c in enumerate(self.classes)]
        )
        return df.withColumn(output, F.array_max(ballots)["c"])


def fit_gaussian_bayes(train: DataFrame, features: Sequence[str], label: str, smoothing: float = 1e-9, max_classes: int = 1000) -> GaussianBayes:
    """Class priors, means and population variances; variances are lifted by ``smoothing``
    times the largest feature variance."""
    stats = train.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.var_pop(f).alias(f"v_{f}") for f in features],
    )
    rows = sorted(stats.limit(max_classes + 1).collect(), key=lambda r: r[label])
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    spread = train.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    lift = smoothing * max(spread[f] for f in features)
    n = sum(r["n"] for r in rows)
    return GaussianBayes(
        list(features),
        [r[label] for r in rows],
        [r["n"] / n for r in rows],
        [[r[f"m_{f}"] for f in features] for r in rows],
        [[r[f"v_{f}"] + lift for f in features] for r in rows],
    )
