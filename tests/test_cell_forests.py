"""Forests of classes on cells: the trees of Spark's rules, grown from counts; small ones stay as they are."""

import numpy as np
import pytest
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import functions as F

from fieldtally.operators import cell_forests, ensembles, models


class EveryRowOnce:
    """No draw: each row counts once, columns are looked at in their order."""

    poisson = staticmethod(lambda counts: counts)
    random = staticmethod(lambda shape: np.broadcast_to(np.arange(shape[1]) / 10, shape))


def made(n, classes=2):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 2, n), rng.integers(0, 14, n)]).astype(float)
    y = (x[:, 0] * 3 + x[:, 2] ** 2 + rng.integers(0, 60, n)).astype(int) // 40 % classes
    return x, y.astype(float)


def counted(x, y, classes):
    cells, at = np.unique(x.astype(np.uint8), axis=0, return_inverse=True)
    return cells, np.array([np.bincount(at[y == c], minlength=len(cells)) for c in range(classes)]).T


@pytest.mark.parametrize("classes, depth", [(2, 4), (2, 30), (3, 6), (2, 0)])
def test_a_tree_is_sparks(spark, classes, depth):
    x, y = made(3000, classes)
    df = spark.createDataFrame([(*a, b) for a, b in zip(x.tolist(), y.tolist())], "a double, b double, c double, label double")
    model = models.fit(df, ["a", "b", "c"], models.classifier("tree", maxDepth=depth)).stages[-1]
    tree = cell_forests.grow_tree(*counted(x, y, classes), 3, depth, EveryRowOnce, 1.0, False)
    assert tree.importances(3) == pytest.approx(model.featureImportances.toArray())
    shares = tree.shares(x.astype(np.uint8))
    expected = model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    got = {(r.a, r.b, r.c): r.probability.toArray() for r in expected.select("a", "b", "c", "probability").collect()}
    assert all(np.allclose(got[tuple(a)], s) for a, s in zip(x.tolist(), shares))


def test_categories_go_by_their_count_of_the_second_class(spark):
    x, y = made(3000)
    y = np.where(x[:, 2] % 3 == 1, 1 - y, y)
    df = spark.createDataFrame([(*a, b) for a, b in zip(x.tolist(), y.tolist())], "a double, b double, c double, label double")
    cuts = Bucketizer(splitsArray=[[-np.inf, *(np.arange(top) + 0.5).tolist(), np.inf] for top in (8, 1, 13)], inputCols=["a", "b", "c"], outputCols=["x", "y", "z"])
    model = models.fit(cuts.transform(df), ["x", "y", "z"], models.classifier("tree", maxDepth=5)).stages[-1]
    assert "in {" in model.toDebugString
    tree = cell_forests.grow_tree(*counted(x, y, 2), 3, 5, EveryRowOnce, 1.0, True)
    assert tree.importances(3) == pytest.approx(model.featureImportances.toArray())


@pytest.fixture(scope="module")
def rows(spark):
    x, y = made(12_000)
    return spark.createDataFrame([(i, *a, b) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist()))], "id long, a double, b double, c double, label double").cache()


def ahead():
    return [VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")]


def forest():
    return models.classifier("forest", numTrees=30, maxDepth=30)


def test_the_forest_grows_on_cells_and_votes_like_sparks(rows, monkeypatch):
    monkeypatch.setattr(ensembles, "GROWN_AT_ONCE", 200_000)
    spark_forest = models.fit(rows, ["a", "b", "c"], forest())
    (part,) = ensembles.grow(rows, forest(), 12_000, ahead())  # before, two forests of 16 and 14 trees that the driver held
    assert isinstance(part, cell_forests.CellForest) and part.getNumTrees == 30 and part.number <= 9 * 2 * 14
    assert ensembles.grown_importances([part]) == pytest.approx(spark_forest.stages[-1].featureImportances.toArray(), abs=0.05)
    out = {r.id: r for r in part.transform(rows).collect()}
    assert len(out) == 12_000 and all(abs(r.rawPrediction.toArray().sum() - 30) < 1e-6 for r in out.values())
    expected = spark_forest.transform(rows).select("id", "probability").collect()
    assert np.mean([abs(r.probability[1] - out[r.id].probability[1]) for r in expected]) < 0.03
    voted = ensembles.vote_of_parts([part], rows, ["id"], 12_000).collect()
    assert {r.id: r.prediction for r in voted} == {i: float(r.probability.toArray().argmax()) for i, r in out.items()}
    again = part.transform(rows.repartition(3)).where("id < 500").collect()
    assert all(np.allclose(r.probability.toArray(), out[r.id].probability.toArray()) for r in again)


def test_rows_of_unknown_cells_are_voted_for(rows, monkeypatch):
    monkeypatch.setattr(ensembles, "GROWN_AT_ONCE", 200_000)
    (part,) = ensembles.grow(rows.where("a < 5 or c < 9"), forest(), 12_000, ahead())
    other = rows.where("a >= 5 and c >= 9")
    assert part.transform(other).where("prediction is not null").count() == other.count() > 0


def test_what_cells_cannot_say_is_grown_by_spark(rows, monkeypatch):
    monkeypatch.setattr(ensembles, "GROWN_AT_ONCE", 1000)

    def on_cells(df, estimator):
        return isinstance(next(iter(ensembles.grow(df, estimator, 12_000, ahead()))), cell_forests.CellForest)

    few = {"numTrees": 2, "maxDepth": 12}
    assert on_cells(rows, models.classifier("forest", **few))
    assert not on_cells(rows, models.classifier("forest", minInstancesPerNode=9, **few))
    assert not on_cells(rows, models.classifier("forest", impurity="entropy", **few))
    with pytest.raises(Exception, match="(?i)null"):
        on_cells(rows.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), models.classifier("forest", **few))
    monkeypatch.setattr(cell_forests, "CELLS", 10)
    assert not on_cells(rows, models.classifier("forest", **few))


def test_boosted_classes_on_cells_are_those_of_the_rows(rows, monkeypatch):
    seen, kept = [], ensembles.class_cells
    monkeypatch.setattr(ensembles, "class_cells", lambda *args: seen.append(kept(*args)) or seen[-1])
    kinds = {"tree": {"maxDepth": 6}, "boosting": {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1}}
    flat = rows.withColumn("flat", F.lit(3.0))
    fitted = ensembles.fit_on_cells(flat, ["a", "b", "c", "flat"], {k: models.classifier(k, **p) for k, p in kinds.items()})
    assert len(seen) == 1 and seen[0].count() <= 9 * 2 * 14 * 2 and seen[0].agg(F.sum("__rows")).first()[0] == 12_000
    for k, p in kinds.items():
        plain = models.fit(flat, ["a", "b", "c", "flat"], models.classifier(k, **p)).transform(flat)
        both = plain.select("id", F.col("probability").alias("p")).join(fitted[k].transform(flat).select("id", "probability"), "id").collect()
        assert len(both) == 12_000 and all(np.allclose(r.p.toArray(), r.probability.toArray()) for r in both)


def test_extra_trees_grow_on_cells(rows):
    params = {"groups": 2, "trees": 20, "depth": 30, "bootstrap": True}
    found = ensembles.fit_extra_trees(rows, ["a", "b", "c"], "label", **params)
    assert all(isinstance(m, cell_forests.CellForest) and m.categories for m in found)
    scored = ensembles.apply_extra_trees(found, rows)
    assert scored.columns == [*rows.columns, "prediction"] and scored.where("prediction is null").count() == 0
    shares = [r.probability for r in found[0].transform(rows).orderBy("id").select("probability").collect()]
    cuts, names = found[0].ahead[0], list(found[0].names)
    plain = models.fit(cuts.transform(rows), names, models.classifier("forest", numTrees=20, maxDepth=30, seed=7))
    expected = [r.probability for r in plain.transform(cuts.transform(rows)).orderBy("id").select("probability").collect()]
    assert np.mean([abs(a[1] - b[1]) for a, b in zip(shares, expected)]) < 0.03
