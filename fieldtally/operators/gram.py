"""Cross-validated linear models from sums: one pass over the rows, whatever the number of folds and grid points.

Least squares, ridge and the elastic net need nothing of the rows but the sums of products of their columns.
These are taken once per fold in a single aggregate; the sums of a training set are those of all other folds
together, and the held-out error follows from the held-out sums.  The driver solves systems as wide as the columns,
never as long as the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sums:
    """Number of rows, and the sums of products of (1, x1, ..., xd, y)."""

    n: int
    products: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.products + other.products)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.products - other.products)

    def without(self, place: int) -> Sums:
        """The sums of a table that lacks one column (1 is the first input)."""
        return Sums(self.n, np.delete(np.delete(self.products, place, 0), place, 1))

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(covariances of the inputs, their covariances with y, means of the inputs, mean of y)."""
        mean = self.products[0, 1:] / self.n
        cov = self.products[1:, 1:] / self.n - np.outer(mean, mean)
        return cov[:-1, :-1], cov[:-1, -1], mean[:-1], float(mean[-1])

    def squared_error(self, intercept: float, slopes: np.ndarray) -> float:
        """Mean squared error of a linear model on these rows."""
        w = np.concatenate(([-intercept], -slopes, [1.0]))
        return float(w @ self.products @ w / self.n)


def fold_sums(df: DataFrame, inputs: Sequence[str], target: str, fold: Column) -> dict[int, Sums]:
    """One aggregate row per fold; rows with a missing value count nowhere."""
    names = [*inputs, target]
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    complete = df.dropna(subset=names)
    cells = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    rows = complete.groupBy(fold.alias("__fold")).agg(*[F.sum(values[i] * values[j]).alias(f"s{i}_{j}") for i, j in cells]).collect()
    out = {}
    for r in rows:
        products = np.zeros((len(values), len(values)))
        for i, j in cells:
            products[i, j] = products[j, i] = r[f"s{i}_{j}"]
        out[r["__fold"]] = Sums(int(round(products[0, 0])), products)
    return out


def solve(sums: Sums, penalty: float = 0.0, mix: float = 0.0, tolerance: float = 1e-12, sweeps: int = 100_000) -> tuple[float, np.ndarray]:
    """(intercept, slopes) that minimise half the mean squared error plus ``penalty`` times (mix * sum of sizes + (1 - mix) / 2 *
    sum of squares) of the slopes of standardised inputs; the intercept is free.  ``mix`` 0: ridge, 1: lasso."""
    cov, with_y, means, mean_y = sums.centred()
    variances = np.maximum(np.diag(cov), 0.0)
    used = variances > 1e-13 * (variances + means**2)  # less is the rounding of a constant
    scale = np.where(used, np.sqrt(variances), 0.0)
    q = cov[np.ix_(used, used)] / np.outer(scale[used], scale[used])
    c = with_y[used] / scale[used]
    if mix == 0.0 or penalty == 0.0:
        beta = np.linalg.lstsq(q + penalty * np.eye(len(c)), c, rcond=None)[0]
    else:
        beta = np.zeros(len(c))
        for _ in range(sweeps):
            moved = 0.0
            for k in range(len(c)):
                pull = c[k] - q[k] @ beta + q[k, k] * beta[k]
                new = np.sign(pull) * max(abs(pull) - penalty * mix, 0.0) / (q[k, k] + penalty * (1 - mix))
                moved, beta[k] = max(moved, abs(new - beta[k])), new
            if moved < tolerance * max(1.0, float(np.abs(beta).max(initial=0.0))):
                break
    slopes = np.zeros(len(scale))
    slopes[used] = beta / scale[used]
    return mean_y - float(slopes @ means), slopes


def search(folds: Mapping[int, Sums], grid: Sequence[tuple[float, float]]) -> list[dict]:
    """Per grid point (penalty, mix) and fold: the model fitted on all other folds, and its error on this one."""
    everything = None
    for s in folds.values():
        everything = s if everything is None else everything + s
    out = []
    for penalty, mix in grid:
        for fold, held in sorted(folds.items()):
            intercept, slopes = solve(everything - held, penalty, mix)
            out.append({
                "penalty": float(penalty), "mix": float(mix), "fold": int(fold), "train": everything.n - held.n, "held": held.n, "intercept": intercept,
                "slopes": slopes.tolist(), "rmse": max(held.squared_error(intercept, slopes), 0.0) ** 0.5,
            })
    return out


def search_table(spark: SparkSession, found: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in found], "penalty double, mix double, fold int, train long, held long, intercept double, slopes array<double>, rmse double")


def best(found: Sequence[dict]) -> tuple[float, float]:
    """The grid point with the smallest mean error over folds; ties go to the larger penalty."""
    points: dict[tuple[float, float], list[float]] = {}
    for r in found:
        points.setdefault((r["penalty"], r["mix"]), []).append(r["rmse"])
    return min(points, key=lambda p: (round(sum(points[p]) / len(points[p]), 12), -p[0], p[1]))
