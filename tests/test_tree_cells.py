"""Regression trees on cells of bins: what trees on the rows themselves give, from as many rows as there are cells."""

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import ensembles, models

FEATURES = ["a", "b", "c"]
KINDS = {"tree": {"maxDepth": 5}, "boosting": {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1}}


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i % 7, i * 13 % 2, i * 37 % 997, float(i % 7 * 10 + (i * 37 % 997) ** 2 % 811 + i * 29 % 101)) for i in range(4000)]
    return spark.createDataFrame(made, "a int, b int, c int, y double").coalesce(1).cache()


def estimators():
    return {k: models.regressor(k, label="y", **p) for k, p in KINDS.items()}


def test_cells_give_the_trees_of_the_rows(rows, monkeypatch):
    seen = []
    kept = ensembles.cells
    monkeypatch.setattr(ensembles, "cells", lambda *args: seen.append(kept(*args)) or seen[-1])
    fitted = ensembles.fit_on_cells(rows, FEATURES, estimators())
    assert len(seen) == 1 and seen[0].count() <= 7 * 2 * 32 and seen[0].agg(F.sum("__rows")).first()[0] == 4000
    for k, est in estimators().items():
        plain = models.fit(rows, FEATURES, est)
        assert fitted[k].stages[-1].featureImportances.toArray() == pytest.approx(plain.stages[-1].featureImportances.toArray())
        a, b = ([r.prediction for r in m.transform(rows).collect()] for m in (plain, fitted[k]))
        assert a == pytest.approx(b)


def test_what_draws_or_counts_rows_is_fitted_on_rows(rows, monkeypatch):
    monkeypatch.setattr(ensembles, "cells", lambda *_: pytest.fail("cells"))
    drawn = {
        "forest": models.regressor("forest", label="y", numTrees=3), "some": models.regressor("boosting", label="y", maxIter=2, subsamplingRate=0.5),
        "leaves": models.regressor("tree", label="y", minInstancesPerNode=5), "other": models.regressor("boosting", label="y", maxIter=2, lossType="absolute"),
    }
    assert set(ensembles.fit_on_cells(rows, FEATURES, drawn)) == set(drawn)
    monkeypatch.setattr(ensembles, "CELLS", 10)
    ensembles.fit_on_cells(rows, FEATURES, {"tree": estimators()["tree"]})


def test_a_missing_label_is_not_averaged_away(rows):
    holed = rows.withColumn("y", F.when(F.col("c") != 5, F.col("y")))
    with pytest.raises(Exception, match="(?i)null|nan"):
        ensembles.fit_on_cells(holed, FEATURES, estimators())
