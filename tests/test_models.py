"""Order statistics, neighbours, spatial jobs, ensembles and metrics against brute force."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import bayes, ensembles, metrics, models, neighbours, prepare, profile, spatial, tuning


@pytest.mark.parametrize("small", [1_000_000, 5])
def test_exact_medians(spark, small):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), None if i % 3 else rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = profile.exact_medians(df, ["a", "b", "c"], small=small)
    for i, c in enumerate("abc"):
        assert got[c] == pytest.approx(statistics.median(r[i] for r in rows if r[i] is not None))


def test_medians_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert profile.exact_medians(df, ["a", "b"]) == {"a": None, "b": 1.0}


def test_mode_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert profile.modes(df, ["x"]) == {"x": "a"}


@pytest.mark.parametrize("p,exclude,cells", [(2, True, 4_000_000), (2, False, 200), (1, True, 900)])
def test_neighbours_match_brute_force(spark, monkeypatch, p, exclude, cells):
    monkeypatch.setattr(neighbours, "CELLS", cells)
    rng = np.random.default_rng(3)
    # a third of the points are copies of one vector
    x = np.vstack([rng.normal(size=(60, 4)), np.repeat(rng.normal(size=(1, 4)), 30, axis=0)])
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "id long, v array<double>, y int")
    got = neighbours.nearest_neighbours(df, df, "id", "v", 4, "y", p=p, exclude_self=exclude)
    found = {}
    for r in got.orderBy("qid", "place").collect():
        found.setdefault(r.qid, []).append((r.pid, round(r.distance, 9)))
    for q in range(len(x)):
        d = np.abs(x - x[q]).sum(axis=1) if p == 1 else np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = sorted((dist, i) for i, dist in enumerate(d) if not (exclude and i == q))[:4]
        assert found[q] == [(i, round(float(dist), 9)) for dist, i in order]


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_neighbours_of_few_rows(spark, rows):
    df = spark.createDataFrame([(i, [float(i)] * 3, "x") for i in range(rows)], "id long, v array<float>, y string")
    got = neighbours.nearest_neighbours(df, df, "id", "v", 4, "y", exclude_self=True).collect()
    assert len(got) == rows * max(0, rows - 1)


def test_fitted_rows_are_bounded(spark):
    df = spark.range(100).selectExpr("id", "array(cast(id as double)) v", "id y")
    fitted = neighbours.fit_neighbours(df, "id", "v", "y", most=10)
    again = neighbours.fit_neighbours(df.repartition(7), "id", "v", "y", most=10)
    assert len(fitted.ids) == 10 and fitted.ids.tolist() == again.ids.tolist()
    assert fitted.nearest(df, "id", "v", 3).count() == 300


@pytest.mark.parametrize("width", [10, 128])
def test_whole_vectors(spark, tmp_path, width):
    from fieldtally.catalog.tables import vectors

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=width)], i % 2) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df, n = vectors(spark, str(tmp_path))
    assert n == width and {len(r.vec) for r in df.collect()} == {width}
    spark.createDataFrame([(99, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(ValueError):
        vectors(spark, str(tmp_path))


def test_delimited_text_survives(spark, tmp_path):
    from fieldtally.sources.files import read_delimited, write_delimited

    texts = ["a\nb", "a\r\nb\r", "", None, ' "x", ', '"', '""', "\\", '\\"', ",", " ", "\n", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    path = write_delimited(df, f"{tmp_path}/t", null_text="\\N")
    back = read_delimited(spark, path, df.schema, null_text="\\N", multi_line=True)
    assert {r.id: r.text for r in back.collect()} == dict(enumerate(texts))
    broken = spark.createDataFrame([("id,text",), ("x,y",)], "value string")
    broken.coalesce(1).write.text(f"{tmp_path}/broken")
    with pytest.raises(Exception):
        read_delimited(spark, f"{tmp_path}/broken", df.schema).collect()


def test_votes(spark):
    rows = [(1, 10, "a", 1.0), (1, 11, "b", 2.0), (1, 12, "b", 4.0), (2, 10, "a", 0.0), (2, 11, "b", 0.1), (2, 12, "b", 0.1)]
    near = spark.createDataFrame(rows, "qid long, pid long, payload string, distance double")
    assert {r.qid: r.prediction for r in neighbours.knn_vote(near).collect()} == {1: "b", 2: "b"}
    assert {r.qid: r.prediction for r in neighbours.knn_vote(near, "distance").collect()} == {1: "a", 2: "a"}


def ring(points):
    closed = [*points, points[0]]
    return [(float(x), float(y)) for x, y in closed]


SHAPES = {
    "square": ring([(0, 0), (2, 0), (2, 2), (0, 2)]),
    "ell": ring([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]),
    "sliver": ring([(0, 0), (100, 100), (100, 100.5)]),
}
CENTROIDS = {"square": (4.0, 1.0, 1.0), "ell": (7.0, 9.5 / 7, 9.5 / 7), "sliver": (25.0, 200 / 3, 200.5 / 3)}


def test_centroids(spark):
    df = spark.createDataFrame(list(SHAPES.items()), "geo string, ring array<struct<x:double,y:double>>")
    whole = {r.geo: (r.area, r.cx, r.cy) for r in spatial.ring_centroids(df, "ring", ["geo"]).collect()}
    vertices = df.select("geo", F.lit(0).alias("part"), F.posexplode("ring").alias("seq", "v")).select("geo", "part", "seq", "v.*")
    joined = {r.geo: (r.area, r.cx, r.cy) for r in spatial.vertex_centroids(vertices, "geo", "part", "seq").collect()}
    for name, want in CENTROIDS.items():
        assert whole[name] == pytest.approx(want, abs=1e-5)
        assert joined[name] == pytest.approx(want, abs=1e-5)


def inside(x, y, points):
    hit = False
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            hit = not hit
    return hit


def test_dots_are_inside_and_counted(spark):
    rows = [(name, pts, n) for (name, pts), n in zip(SHAPES.items(), (50, 2500, 40))]
    df = spark.createDataFrame([*rows, ("none", SHAPES["square"], 0)], "geo string, ring array<struct<x:double,y:double>>, n long")
    dots = spatial.dot_density(df, ["geo"], "ring", "n", seed=5, chunk=100)
    found = {}
    for r in dots.collect():
        found.setdefault(r.geo, []).append((r.dot, r.x, r.y))
    assert {g: len(v) for g, v in found.items()} == {"square": 50, "ell": 2500, "sliver": 40}
    for g, v in found.items():
        assert sorted(d for d, _, _ in v) == list(range(1, len(v) + 1))
        assert all(inside(x, y, SHAPES[g]) for _, x, y in v)
    # three sevenths of the ell's area lie right of the upright's edge
    share = sum(x > 1 for _, x, _ in found["ell"]) / 2500
    assert abs(share - 3 / 7) < 0.04
    again = {(r.geo, r.dot): (r.x, r.y) for r in spatial.dot_density(df, ["geo"], "ring", "n", seed=5, chunk=7).collect()}
    assert again == {(g, d): (x, y) for g, v in found.items() for d, x, y in v}


def table(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(3, n))
    y = (a + 0.5 * b + 0.2 * rng.normal(size=n) > 0).astype(float)
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), float(3 * a[i] - 2 * b[i] + 1)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label double, target double")


def accuracy(df):
    return metrics.classification_metrics(df, "label", "prediction", 1.0).first().accuracy


def test_ensembles_learn(spark):
    df = prepare.assemble(table(spark), ["a", "b", "c"]).cache()
    assert accuracy(ensembles.fit_adaboost(df, "label", rounds=6, cut_every=2).apply(df)) > 0.85
    bags = ensembles.fit_bagging(df, ["a", "b", "c"], "label", estimators=6, column_share=0.67, column_sets=3)
    assert accuracy(ensembles.apply_bagging(bags, df)) > 0.85
    extra = ensembles.fit_extra_trees(df, ["a", "b", "c"], "label", groups=3, trees=5)
    assert accuracy(ensembles.apply_extra_trees(extra, df)) > 0.8
    numbers = ensembles.fit_adaboost_regressor(df, "target", rounds=5, cut_every=2).apply(df)
    assert metrics.regression_metrics(numbers, "target", "prediction").first().r2 > 0.7


def test_adaboost_stops_on_a_perfect_tree(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "a double, label double")
    votes = ensembles.fit_adaboost(prepare.assemble(df, ["a"]), "label", rounds=5)
    assert len(votes.models) == 1
    assert accuracy(votes.apply(prepare.assemble(df, ["a"]))) == 1.0


def test_weighted_median(spark):
    df = spark.createDataFrame([(1.0, 5.0, 9.0)], "__p0 double, __p1 double, __p2 double")
    for weights, want in (([1, 1, 1], 5.0), ([5, 1, 1], 1.0), ([1, 1, 5], 9.0)):
        vote = ensembles.Vote([], [float(w) for w in weights], None, "features")
        assert df.select(vote._median(["__p0", "__p1", "__p2"])).first()[0] == want


def test_linear_family(spark):
    df = table(spark)
    linear = models.fit(df, ["a", "b"], models.regressor("linear", label="target"))
    assert linear.stages[-1].coefficients.toArray().tolist() == pytest.approx([3, -2], abs=1e-6)
    for kind in ("logistic", "margin"):
        assert accuracy(models.fit(df, ["a", "b", "c"], models.classifier(kind)).transform(df)) > 0.9
    ridge = models.fit_ridge_classifier(df, ["a", "b", "c"], "label", 0.01)
    assert accuracy(models.apply_ridge_classifier(ridge, df)) > 0.9


def test_kernel_features_approximate_the_kernel(spark):
    df = table(spark, 20)
    rows = models.kernel_features(df, ["a", "b"], gamma=0.5, size=4000).collect()
    for r, s in ((rows[0], rows[1]), (rows[2], rows[7])):
        exact = math.exp(-0.5 * ((r.a - s.a) ** 2 + (r.b - s.b) ** 2))
        assert float(r.kernel_features.dot(s.kernel_features)) == pytest.approx(exact, abs=0.06)


def test_stack_with_held_out_predictions(spark):
    df = table(spark).withColumnRenamed("target", "y")
    def base():
        return {"lin": models.Pipeline(stages=[models.VectorAssembler(inputCols=["a", "b"], outputCol="features"), models.regressor("linear", label="y")])}

    for folds in (0, 3):
        stack = ensembles.fit_stack(df, base(), ["a", "b"], models.regressor("forest", label="y", numTrees=10), "id", folds)
        assert metrics.regression_metrics(stack.apply(df), "y", "prediction").first().r2 > 0.8


def test_components(spark):
    df = table(spark).withColumn("d", F.col("a") * 2 + F.col("b"))
    names = ["a", "b", "c", "d"]
    x = np.array([[r[n] for n in names] for r in df.orderBy("id").collect()])
    for scale, center in ((True, True), (False, True), (False, False)):
        fitted = prepare.fit_pca(df, names, 2, scale, center)
        z = x - x.mean(axis=0) if center else x
        z = z / x.std(axis=0) if scale else z
        values, vectors = np.linalg.eigh(z.T @ z)
        for i in range(2):
            want = vectors[:, -1 - i]
            want = -want if want[np.abs(want).argmax()] < 0 else want
            assert fitted.loadings[i] == pytest.approx(want.tolist(), abs=1e-6)
            got = [r[0] for r in fitted.apply(df).orderBy("id").select(f"PC{i + 1}").collect()]
            assert got == pytest.approx((z @ want).tolist(), abs=1e-6)


def test_gaussian_bayes(spark):
    df = table(spark)
    fitted = bayes.fit_gaussian_bayes(df, ["a", "b", "c"], "label")
    assert accuracy(fitted.apply(df)) > 0.85


def test_recorded_confusion_gives_recorded_scores(spark):
    counts = spark.createDataFrame([(15094, 727, 438, 12541)], "tp long, fp long, fn long, tn long")
    r = metrics.scores_from_counts(counts, 3).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.96, 0.954, 0.972, 0.963)


def test_regression_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert (r.mse, r.mae) == (pytest.approx(2 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))
    assert r.r2 == pytest.approx(1 - 2 / (14 / 3), abs=1e-6)


def test_hash_folds_cover_all_rows(spark):
    df = table(spark).withColumn("f", tuning.hash_fold("id", 5))
    counts = {r.f: r["count"] for r in df.groupBy("f").count().collect()}
    assert sorted(counts) == [0, 1, 2, 3, 4] and sum(counts.values()) == 300


def test_onehot_drops_the_first_level_and_ignores_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "x string")
    hot = prepare.fit_onehot(df.where("x <> 'c'"), ["x"])
    assert [tuple(r) for r in hot.apply(df).collect()] == [(1,), (0,), (0,), (0,)]
    with pytest.raises(ValueError):
        prepare.fit_onehot(df, ["x"], max_levels=2)


def test_time_split_leaves_later_rows_out(spark):
    df = spark.createDataFrame([(2023, 9), (2024, 1), (2024, 2), (2024, 3)], "year int, week int")
    train, test = prepare.time_split(df, {"year": 2024, "week": 2})
    assert (train.count(), test.count()) == (2, 1)
    assert prepare.latest_period(df, "year", "week") == {"year": 2024, "week": 4}


def test_products(spark):
    df = spark.createDataFrame([(2, 3, 5)], "a int, b int, c int")
    out = prepare.pairwise_products(df, columns=["a", "b", "c"])
    assert out.columns[3:] == ["a|b", "a|c", "b|c"] and tuple(out.first())[3:] == (6, 10, 15)
    assert prepare.interaction_names(out.columns) == ["a|b", "a|c", "b|c"]
