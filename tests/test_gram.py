"""Fold sums and models solved from them, against fits on the rows themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import gram

rng = np.random.default_rng(3)
X = rng.normal(size=(300, 4)) * [1, 10, 0.1, 1] + [0, 5, 0, -2]
X[:, 3] = X[:, 0] + 0.1 * X[:, 3]
Y = X @ [1.5, -0.2, 4.0, 0.0] + rng.normal(size=300)


@pytest.fixture(scope="module")
def folds(spark):
    rows = [(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(X, Y))] + [(7, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, y double")
    return gram.fold_sums(df, ["a", "b", "c", "d"], "y", (F.col("i") % 5).cast("int"))


def objective(x, y, intercept, slopes, penalty, mix):
    scaled = slopes * x.std(axis=0)
    return 0.5 * np.mean((y - intercept - x @ slopes) ** 2) + penalty * (mix * np.abs(scaled).sum() + (1 - mix) / 2 * (scaled**2).sum())


@pytest.mark.parametrize("penalty, mix", [(0.0, 0.0), (0.5, 0.0), (0.05, 1.0), (0.2, 0.5), (50.0, 1.0)])
def test_models_are_optimal(folds, penalty, mix):
    for row in gram.search(folds, [(penalty, mix)]):
        train = np.arange(300) % 5 != row["fold"]
        x, y, slopes = X[train], Y[train], np.array(row["slopes"])
        assert (row["train"], row["held"]) == (240, 60)
        here = objective(x, y, row["intercept"], slopes, penalty, mix)
        for step in rng.normal(size=(200, 5)) * 1e-3:  # the problem is convex: no neighbour is better
            assert here <= objective(x, y, row["intercept"] + step[0], slopes + step[1:], penalty, mix) + 1e-12
        rest = Y[~train] - row["intercept"] - X[~train] @ slopes
        assert row["rmse"] == pytest.approx(np.sqrt(np.mean(rest**2)), rel=1e-9)
        if penalty == 0:
            exact = np.linalg.lstsq(np.column_stack([np.ones(240), x]), y, rcond=None)[0]
            assert np.allclose([row["intercept"], *slopes], exact)
        if penalty == 50:
            assert not slopes.any()


def test_best_and_constant_column(spark, folds):
    found = gram.search(folds, [(0.0, 0.0), (5.0, 0.0), (5.0, 1.0)])
    assert gram.best(found) == (0.0, 0.0)
    df = spark.createDataFrame([(i % 2, 1.0, float(i), 2.0 * i) for i in range(10)], "f int, k double, x double, y double")
    for row in gram.search(gram.fold_sums(df, ["k", "x"], "y", F.col("f")), [(0.0, 0.0), (0.01, 1.0)]):
        assert row["slopes"][0] == 0.0 and row["slopes"][1] == pytest.approx(2.0, abs=0.01)
