"""Deep forests in parts: no forest above the bound is grown at once, and the parts make up the whole."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import RandomForestClassifier

from fieldtally.operators import ensembles, models


@pytest.fixture(scope="module")
def rows(spark):
    made = [(float(i * 7 % 31), float(i * 5 % 17), float((i * 7 % 31 > 15) != (i % 9 == 0))) for i in range(300)]
    return spark.createDataFrame(made, "a double, b double, label double").cache()


def ahead():
    return [VectorAssembler(inputCols=["a", "b"], outputCol="features")]


def forest(trees=12, depth=30):
    return models.classifier("forest", numTrees=trees, maxDepth=depth)


def test_parts_stay_below_the_bound(monkeypatch):
    monkeypatch.setattr(ensembles, "GROWN_AT_ONCE", 1000)
    assert ensembles.forest_parts(12, 30, 300) == [3, 3, 3, 3]
    assert ensembles.forest_parts(7, 30, 10**9) == [1] * 7  # never fewer trees than asked for
    assert ensembles.forest_parts(100, 3, 10**9) == [100]  # shallow trees are small whatever the rows
    assert ensembles.forest_parts(12, 30, 0) == [12]


def test_one_part_is_the_plain_forest(rows):
    plain = models.fit(rows, ["a", "b"], RandomForestClassifier(numTrees=12, maxDepth=30, seed=1, labelCol="label", featuresCol="features")).stages[-1]
    (part,) = ensembles.grow(rows, forest(), 300, ahead())
    assert part.stages[-1].toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]
    assert np.allclose(ensembles.grown_importances([part]), plain.featureImportances.toArray(), atol=1e-15)


def test_parts_vote_like_one_forest(rows, monkeypatch):
    monkeypatch.setattr(ensembles, "GROWN_AT_ONCE", 1000)
    parts = list(ensembles.grow(rows, forest(), 300, ahead()))
    assert [p.stages[-1].getNumTrees for p in parts] == [3, 3, 3, 3]
    assert len({p.stages[-1].toDebugString.split("\n", 1)[1] for p in parts}) == 4
    assert all(p.stages[-1].getFeatureSubsetStrategy() == "sqrt" for p in parts)
    shares = {}
    for p in parts:
        for r in p.transform(rows).select("a", "b", "rawPrediction").collect():
            shares[r.a, r.b] = shares.get((r.a, r.b), 0) + r.rawPrediction.toArray()
    got = ensembles.vote_of_parts(iter(parts), rows, ["a", "b", "label"], 300).collect()
    assert len(got) == 300 and {(r.a, r.b): r.prediction for r in got} == {k: float(np.argmax(v)) for k, v in shares.items()}
    weights = ensembles.grown_importances(parts)
    assert np.allclose(weights, sum(p.stages[-1].featureImportances.toArray() for p in parts) / 4)
