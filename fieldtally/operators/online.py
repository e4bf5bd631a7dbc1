"""Perceptron and passive-aggressive classifiers: rows in turn inside parts, weights averaged over the parts each epoch.

A row changes the weights only if they get it wrong (or, passive-aggressive, within the margin).  Rows are dealt into
parts by a column; a part is one stream in the order of its ids, so a task holds one batch and one vector of weights, and a
rerun gives the same model.  The parts' weights are averaged by their rows and sent out again for the next epoch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import as_col
from ..session import store


@dataclass
class Linear:
    """Weights of the inputs, the intercept first; a score above zero means class 1."""

    features: list[str]
    weights: list[float]

    def score(self) -> Column:
        total = F.lit(self.weights[0])
        for w, c in zip(self.weights[1:], self.features):
            total = total + F.lit(w) * F.col(c).cast("double")
        return total

    def apply(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, F.when(self.score() > 0, 1.0).when(self.score().isNotNull(), 0.0))


def turn(weights: list[float], row: list[float], sign: float, most: float | None) -> float:
    """How far a row moves the weights: all the way if wrong (perceptron), or as far as the margin needs, up to ``most``."""
    score = weights[0]
    for w, x in zip(weights[1:], row):
        score += w * x
    if most is None:
        return 1.0 if sign * score <= 0 else 0.0
    size = 1.0
    for x in row:
        size += x * x
    return min(most, max(0.0, 1.0 - sign * score) / size)


def fit_online(
    df: DataFrame, features: Sequence[str], label: str, id_column: str, part: str | Column, parts: int, epochs: int = 5, most: float | None = None
) -> Linear:
    """``label`` is 0 or 1; ``most`` None: perceptron, else the passive-aggressive limit of a step.  Rows with a missing value
    take no part.  ``part`` numbers the parts; more parts than tasks do no harm."""
    features = list(features)
    rows = df.dropna(subset=[*features, label]).select(
        as_col(part).cast("long").alias("part"), F.col(id_column).alias("id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("sign"),
    )
    rows = store(rows, "online-rows").repartition(parts, "part").sortWithinPartitions("part", "id")
    weights = [0.0] * (len(features) + 1)
    for _ in range(epochs):
        start = list(weights)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            here, now, seen = None, [], 0
            done: list[tuple] = []
            for batch in batches:
                inputs = np.column_stack([batch.column(i).to_numpy() for i in range(2, 2 + len(features))]).tolist()
                for p, row, sign in zip(batch.column(0).to_pylist(), inputs, batch.column(2 + len(features)).to_pylist()):
                    if p != here:
                        if seen:
                            done.append((now, seen))
                        here, now, seen = p, list(start), 0
                    step = turn(now, row, sign, most) * sign
                    seen += 1
                    if step:
                        now[0] += step
                        for i, x in enumerate(row):
                            now[i + 1] += step * x
            if seen:
                done.append((now, seen))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.list_(pa.float64())), pa.array([d[1] for d in done], pa.int64())], names=["w", "n"])

        found = rows.mapInArrow(learn, "w array<double>, n long").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("w")[i] * F.col("n")).alias(f"w{i}") for i in range(len(weights))]
        ).first()
        if not found.n:
            break
        weights = [found[f"w{i}"] / found.n for i in range(len(weights))]
    return Linear(features, weights)
