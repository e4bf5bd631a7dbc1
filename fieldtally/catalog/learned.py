"""Preparation, models, ensembles and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import bayes, components, ensembles, gram, metrics, models, neighbours, online, prepare, ranking, sets, tuning
from ..session import store, store_for_fits
from ..sources.files import table
from .registry import query
from .tables import FEATURES, PLAYS_SQL, TABULAR_SQL, plays, tabular, vectors

CUT = "1998-01-01"

# Training sizes of the published models: fixed values
FOLDS, REPEATS = 10, 5
BOOSTING = {"maxIter": 200, "maxDepth": 3, "stepSize": 0.1}
FOREST = {"numTrees": 200, "maxDepth": 30}
EXTRA_TREES = {"groups": 5, "trees": 40, "depth": 30, "bootstrap": True}
BAGS, BAG_DEPTH = 100, 10
ROUNDS = 50


def halves(df):
    """Orders before the cut date train, the others are scored."""
    cut = F.lit(CUT).cast("timestamp_ntz")
    return df.where(F.col("o_orderdate") < cut), df.where(F.col("o_orderdate") >= cut)


@query(
    "impute_mean",
    f"""WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders),
      m AS (SELECT avg(price) AS mean FROM o WHERE o_orderdate < TIMESTAMP '{CUT}')
      SELECT o_orderkey, round(coalesce(price, mean), 4) AS price, CAST(o_orderdate < TIMESTAMP '{CUT}' AS INTEGER) AS is_train FROM o, m""",
)
def impute_mean(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price")
    )
    train, test = halves(o)
    fitted = prepare.fit_mean_impute(train, ["price"])
    both = sets.bind_rows(fitted.apply(train).withColumn("is_train", F.lit(1)), fitted.apply(test).withColumn("is_train", F.lit(0)))
    return both.select("o_orderkey", F.round("price", 4).alias("price"), "is_train")


@query(
    "impute_median_mode",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN CAST(p_size AS DOUBLE) END AS size,
                         CASE WHEN p_size <> 9 THEN p_retailprice END AS price, CASE WHEN p_size > 5 THEN p_brand END AS brand FROM part),
       top AS (SELECT brand FROM p WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 1)
       SELECT p_partkey, coalesce(size, (SELECT median(size) FROM p)) AS size, coalesce(price, (SELECT median(price) FROM p)) AS price,
              coalesce(brand, (SELECT brand FROM top)) AS brand FROM p""",
)
def impute_median_mode(spark, sf):
    size = F.col("p_size")
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(size > 3, size.cast("double")).alias("size"),
        F.when(size != 9, F.col("p_retailprice")).alias("price"), F.when(size > 5, F.col("p_brand")).alias("brand"),
    )
    numbers = prepare.fit_median_impute(p, ["size", "price"])
    texts = prepare.fit_mode_impute(p, ["brand"])
    return texts.apply(numbers.apply(p))


@query(
    "standardize",
    f"""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}')
      SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS o_totalprice FROM orders, s""",
)
def standardize(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    train, _ = halves(o)
    return prepare.fit_standardize(train, ["o_totalprice"]).apply(o, 6).drop("o_orderdate")


@query(
    "onehot_align",
    """WITH d AS (SELECT d.doc_id, CASE WHEN n_chars > 200 THEN lang END AS lang, CAST(l.doc_id IS NOT NULL AS INTEGER) AS is_train
                  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       SELECT doc_id, is_train, CAST(coalesce(lang = 'en', false) AS INTEGER) AS lang_en, CAST(coalesce(lang = 'es', false) AS INTEGER) AS lang_es,
              CAST(coalesce(lang = 'fr', false) AS INTEGER) AS lang_fr FROM d""",
)
def onehot_align(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 200, F.col("lang")).alias("lang"))
    known = table(spark, sf, "labels").select("doc_id")
    train, test = d.join(known, "doc_id", "left_semi"), d.join(known, "doc_id", "left_anti")
    train, test = sets.transform_together(train, test, lambda both: prepare.fit_onehot(both, ["lang"]).apply(both))
    return sets.bind_rows(train.withColumn("is_train", F.lit(1)), test.withColumn("is_train", F.lit(0)))


@query("pca_scores")
def pca_scores(spark, sf):
    v, _ = vectors(spark, sf)
    fitted = prepare.fit_pca(v, ["vec"], 6)
    scores = [F.round(f"PC{i}", 6).alias(f"PC{i}") for i in range(1, 7)]
    share = [F.lit(round(x, 6)).alias(f"explained_{i + 1}") for i, x in enumerate(fitted.explained)]
    return fitted.apply(v).select("vec_id", *scores, *share)


@query(
    "prefix_components",
    """WITH r AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_tax) AS b, corr(l_discount, l_linenumber) AS c,
                         corr(l_tax, l_linenumber) AS d FROM lineitem)
       SELECT 'size' AS prefix, n, 2.0::DOUBLE AS variance, round(2 + 2 * a * a, 6) AS strength, round(1 + abs(a), 6) AS first, 0.0::DOUBLE AS means, 0.0::DOUBLE AS crossed FROM r
       UNION ALL SELECT 'rate', n, 3.0, round(3 + 2 * (b * b + c * c + d * d), 6), NULL, 0.0, 0.0 FROM r""",
)
def prefix_components(spark, sf):
    """Components of two groups of columns, standardised: what SQL can tell about the scores without the directions. The variances
    add up to the number of columns, their squares to the squared correlations; means and covariances vanish."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("size_quantity"), F.col("l_extendedprice").alias("size_price"), F.col("l_discount").alias("rate_discount"),
        F.col("l_tax").alias("rate_tax"), F.col("l_linenumber").alias("rate_line"),
    )
    blocks = components.fit_blocks(li, components.by_prefix(li.columns, ["size", "rate"]), 3)
    scores = components.bind_scores(li, blocks, drop=True)
    shown = []
    for name, block in blocks.items():
        pcs = [f"{name}_PC{i + 1}" for i in range(len(block.variances))]
        total = lambda cs: reduce(lambda a, b: a + b, cs)
        pairs = [F.abs(F.covar_pop(a, b)) for i, a in enumerate(pcs) for b in pcs[:i]]
        shown.append(scores.agg(
            F.lit(name).alias("prefix"), F.count(pcs[0]).alias("n"), F.round(total([F.var_pop(c) for c in pcs]), 6).alias("variance"),
            F.round(total([F.pow(F.var_pop(c), F.lit(2)) for c in pcs]), 6).alias("strength"),
            (F.round(F.var_pop(pcs[0]), 6) if len(pcs) == 2 else F.lit(None).cast("double")).alias("first"),
            F.round(total([F.abs(F.avg(c)) for c in pcs]), 6).alias("means"), F.round(total(pairs), 6).alias("crossed"),
        ))
    return together(shown)


@query(
    "pairwise_interactions",
    """SELECT l_orderkey, l_quantity * l_extendedprice AS "l_quantity|l_extendedprice", l_quantity * l_discount AS "l_quantity|l_discount",
              l_extendedprice * l_discount AS "l_extendedprice|l_discount", l_tax * l_quantity AS "l_tax|l_quantity" FROM lineitem""",
)
def pairwise_interactions(spark, sf):
    li = table(spark, sf, "lineitem")
    every = prepare.pairwise_products(li, columns=["l_quantity", "l_extendedprice", "l_discount"])
    chosen = prepare.pairwise_products(every, pairs=["l_tax|l_quantity"])
    names = prepare.interaction_names(chosen.columns)
    return chosen.select("l_orderkey", *[F.col(f"`{n}`") for n in names])


@query(
    "time_split",
    f"""WITH {PLAYS_SQL}, m AS (SELECT team, year, week, round(sum(points), 2) AS points FROM plays GROUP BY ALL),
      y AS (SELECT max(year) AS y FROM m), t AS (SELECT y, max(week) AS w FROM m, y WHERE year = y GROUP BY y)
      SELECT team, year, week, points, CASE WHEN year = y AND week = w THEN 'test' ELSE 'train' END AS part FROM m, t
      WHERE year <> y OR week <= w""",
)
def time_split(spark, sf):
    months = plays(spark, sf).groupBy("team", "year", "week").agg(F.round(F.sum("points"), 2).alias("points"))
    months = store(months, "months")
    target = prepare.latest_period(months, "year", "week", ahead=0)
    train, test = prepare.time_split(months, target)
    return sets.bind_rows(train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))


def labelled(spark, sf):
    """Labelled documents with scaled features and language indicators.

    The features are counted over the whole texts once and stored; every fit reads numbers.
    """
    t = store(tabular(spark, sf).withColumn("label", F.col("quality").cast("double")), "labelled")
    hot = prepare.fit_onehot(t, ["lang"])
    scaled = prepare.fit_standardize(t, FEATURES).apply(t)
    return store_for_fits(hot.apply(scaled), "labelled-scaled"), [*FEATURES, *hot.names()]


def scored(name, predicted, label="label"):
    return metrics.classification_metrics(predicted, label, "prediction", 1.0, digits=4).select(F.lit(name).alias("model"), "*")


def together(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("cv_grid")
def cv_grid(spark, sf):
    df, features = labelled(spark, sf)
    estimator = models.classifier("logistic")
    searched = tuning.repeated_search(
        df, REPEATS, estimator=estimator, grid={"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]},
        evaluator=BinaryClassificationEvaluator(), id_column="doc_id", folds=FOLDS, parallelism=8,
        stages=[VectorAssembler(inputCols=features, outputCol="features")],
    )
    df.unpersist()
    return tuning.results_table(searched)


@query(
    "linreg_metrics",
    """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
              round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1""",
)
def linreg_metrics(spark, sf):
    out = models.least_squares(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.withColumns({c: F.round(c, 4) for c in ("slope", "intercept")})


@query(
    "ridge_folds",
    """WITH rows_ AS (SELECT o_custkey % 10 AS fold, CAST(day(o_orderdate) AS DOUBLE) AS x, CAST(o_custkey % 97 AS DOUBLE) AS z, o_totalprice / 1000 AS y FROM orders),
       folds AS (SELECT DISTINCT fold FROM rows_),
       s AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz,
                    covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM folds f JOIN rows_ r ON r.fold <> f.fold GROUP BY 1),
       g AS (SELECT * FROM (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE)) v(penalty)),
       -- two inputs: the normal equations by Cramer's rule, the penalty on standardised slopes
       b AS (SELECT fold, n, penalty, mx, mz, my, (xy * zz * (1 + penalty) - zy * xz) / d AS bx, (zy * xx * (1 + penalty) - xy * xz) / d AS bz
             FROM (SELECT *, xx * zz * (1 + penalty) * (1 + penalty) - xz * xz AS d FROM s, g)),
       e AS (SELECT b.fold, penalty, count(*) AS held, sqrt(avg((y - (my - bx * mx - bz * mz) - bx * x - bz * z) ** 2)) AS rmse
             FROM b JOIN rows_ r ON r.fold = b.fold GROUP BY ALL)
       SELECT 'ridge' AS model, CAST(fold AS INTEGER) AS fold, penalty, n AS train, held, round(bx, 6) AS slope_x, round(bz, 6) AS slope_z,
              round(my - bx * mx - bz * mz, 4) AS intercept, round(rmse, 5) AS rmse FROM b JOIN e USING (fold, penalty)
       UNION ALL
       -- one input: the lasso has a closed form
       SELECT 'lasso', CAST(fold AS INTEGER), penalty, n, held, round(slope, 6), NULL, round(my - slope * mx, 4), round(rmse, 5)
       FROM (SELECT l.fold, penalty, n, mx, my, slope, count(*) AS held, sqrt(avg((y - my + slope * mx - slope * x) ** 2)) AS rmse
             FROM (SELECT *, sign(xy) * greatest(abs(xy) / sqrt(xx) - penalty, 0) / sqrt(xx) AS slope FROM s, g) l JOIN rows_ r ON r.fold = l.fold GROUP BY ALL)""",
)
def ridge_folds(spark, sf):
    """Every fold and penalty from one aggregate over the orders."""
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).alias("part"), F.dayofmonth("o_orderdate").cast("double").alias("x"), (F.col("o_custkey") % 97).cast("double").alias("z"),
        (F.col("o_totalprice") / 1000).alias("y"),
    )
    both = gram.fold_sums(o, ["x", "z"], "y", F.col("part"))
    one = {k: s.without(2) for k, s in both.items()}
    penalties = [0.0, 0.1, 1.0]
    shown = []
    for name, sums, mix in (("ridge", both, 0.0), ("lasso", one, 1.0)):
        found = gram.search_table(spark, gram.search(sums, [(p, mix) for p in penalties]))
        shown.append(found.select(
            F.lit(name).alias("model"), "fold", "penalty", "train", "held", F.round(F.get("slopes", F.lit(0)), 6).alias("slope_x"),
            F.round(F.get("slopes", F.lit(1)), 6).alias("slope_z"), F.round("intercept", 4).alias("intercept"), F.round("rmse", 5).alias("rmse"),
        ))
    return together(shown)


@query("linear_models")
def linear_models(spark, sf):
    """Least squares, and the elastic net on a formula with a text column and interactions."""
    li = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    numbers = ["l_quantity", "l_discount", "l_tax"]
    plain = models.fit(li, numbers, models.regressor("linear", label="l_extendedprice")).transform(li)
    formula = "l_extendedprice ~ . + l_returnflag:l_quantity + l_discount:l_quantity"
    net = models.fit_formula(li, formula).transform(li)
    out = [("least squares", plain), ("elastic net", net)]
    return together(
        [metrics.regression_metrics(p, "l_extendedprice", "prediction", digits=4).select(F.lit(n).alias("model"), "*") for n, p in out]
    )


@query("logreg_metrics")
def logreg_metrics(spark, sf):
    df, features = labelled(spark, sf)
    ridge = models.fit_ridge_classifier(df, features, "label", 0.1)
    out = [
        scored("logistic", models.fit(df, features, models.classifier("logistic")).transform(df)),
        scored("multinomial", models.fit(df, features, models.classifier("multinomial")).transform(df)),
        scored("margin", models.fit(df, features, models.classifier("margin")).transform(df)),
        scored("ridge", models.apply_ridge_classifier(ridge, df)),
    ]
    return together(out)


def _online_sql() -> str:
    score = "w0 + w1 * x1 + w2 * x2 + w3 * x3"
    steps = {
        "perceptron": f"CASE WHEN y * ({score}) <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
        "passive-aggressive": f"least(0.5::DOUBLE, greatest(0.0::DOUBLE, 1 - y * ({score})) / (1 + x1 * x1 + x2 * x2 + x3 * x3))",
    }
    ctes, out = [], []
    for k, (kind, step) in enumerate(steps.items()):
        start = "(SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3)"
        for e in (1, 2):
            f, a = f"f{k}{e}", f"a{k}{e}"
            ctes.append(f"""{f}(part, rn, w0, w1, w2, w3) AS (
              SELECT p.part, 0::BIGINT, w0, w1, w2, w3 FROM (SELECT DISTINCT part FROM r) p, {start} b UNION ALL
              SELECT part, rn, w0 + t * y, w1 + t * y * x1, w2 + t * y * x2, w3 + t * y * x3
              FROM (SELECT r.part, r.rn, w0, w1, w2, w3, x1, x2, x3, y, {step} AS t FROM {f} g JOIN r ON r.part = g.part AND r.rn = g.rn + 1))""")
            ctes.append(f"""{a} AS (SELECT sum(w0 * rn) / sum(rn) AS w0, sum(w1 * rn) / sum(rn) AS w1, sum(w2 * rn) / sum(rn) AS w2, sum(w3 * rn) / sum(rn) AS w3
              FROM (SELECT *, max(rn) OVER (PARTITION BY part) AS m FROM {f}) WHERE rn = m)""")
            start = a
            out.append(f"""SELECT '{kind}' AS model, {e} AS epochs, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, hits
              FROM {a}, (SELECT count(*) AS hits FROM r, {a} WHERE ({score} > 0) = (y > 0))""")
    return f"""WITH RECURSIVE {TABULAR_SQL}, r AS (
        SELECT doc_id % 4 AS part, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS rn, n_chars / 1000.0::DOUBLE AS x1, commas / 10.0::DOUBLE AS x2,
               stops / 10.0::DOUBLE AS x3, CASE WHEN quality > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM tabular),
      {", ".join(ctes)} {" UNION ALL ".join(out)}"""


@query("online_classifiers", _online_sql())
def online_classifiers(spark, sf):
    """Perceptron and passive-aggressive learner after one and two epochs, four parts each."""
    t = store(
        tabular(spark, sf).select(
            "doc_id", "quality", (F.col("n_chars") / 1000).alias("chars"), (F.col("commas") / 10).alias("commas"), (F.col("stops") / 10).alias("stops")
        ),
        "online",
    )
    out = []
    for name, most in (("perceptron", None), ("passive-aggressive", 0.5)):
        for epochs in (1, 2):
            model = online.fit_online(t, ["chars", "commas", "stops"], "quality", "doc_id", F.col("doc_id") % 4, 4, epochs, most)
            hits = model.apply(t).agg(F.count_if(F.col("prediction") == F.col("quality")).alias("hits"))
            weights = [F.round(F.lit(w), 6).alias(f"w{i}") for i, w in enumerate(model.weights)]
            out.append(hits.select(F.lit(name).alias("model"), F.lit(epochs).alias("epochs"), *weights, "hits"))
    return together(out)


@query("tree_models")
def tree_models(spark, sf):
    df, features = labelled(spark, sf)
    rows = df.count()
    kinds = {"tree": {"maxDepth": 6}, "boosting": BOOSTING}
    fitted = ensembles.fit_on_cells(df, features, {k: models.classifier(k, **p) for k, p in kinds.items()})
    one = {k: scored(k, m.transform(df)) for k, m in fitted.items()}
    # deep trees grow with the rows: they vote a few at a time
    parts = ensembles.grow(df, models.classifier("forest", **FOREST), rows, [VectorAssembler(inputCols=features, outputCol="features")])
    one["forest"] = scored("forest", ensembles.vote_of_parts(parts, df, ["label"], rows))
    extra = ensembles.fit_extra_trees(df, features, "label", **EXTRA_TREES)
    one["extra trees"] = scored("extra trees", ensembles.apply_extra_trees(extra, df))
    return together([one[k] for k in ("tree", "forest", "boosting", "extra trees")])


@query("tree_regressors")
def tree_regressors(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        (F.col("o_orderstatus") == "F").cast("int").alias("done"), F.col("o_custkey").alias("customer"),
    )
    o = store_for_fits(o, "orders")
    features = ["year", "month", "done", "customer"]
    kinds = {"tree": {"maxDepth": 5}, "forest": {"numTrees": BAGS, "maxDepth": 5}, "boosting": BOOSTING}
    # the forest draws rows and is fitted on them, the others on the cells of their bins
    fitted = ensembles.fit_on_cells(o, features, {k: models.regressor(k, label="o_totalprice", **p) for k, p in kinds.items()})
    out = [(k, m.transform(o)) for k, m in fitted.items()]
    extra = ensembles.fit_extra_trees(o, features, "o_totalprice", kind="numbers", groups=5, trees=BAGS // 5)
    out.append(("extra trees", ensembles.apply_extra_trees(extra, o, "numbers")))
    return together(
        [metrics.regression_metrics(p, "o_totalprice", "prediction", digits=4).select(F.lit(n).alias("model"), "*") for n, p in out]
    )


@query("adaboost")
def adaboost(spark, sf):
    df, features = labelled(spark, sf)
    ready = prepare.assemble(df, features).cache()
    blind = prepare.assemble(df, [c for c in features if c != "n_chars"])  # the label is no feature
    votes = ensembles.fit_adaboost(ready, "label", rounds=ROUNDS)
    numbers = ensembles.fit_adaboost_regressor(blind, "n_chars", rounds=ROUNDS)
    classes = scored("adaboost", votes.apply(ready)).select("model", "accuracy", "precision", "recall", "f1")
    fit = metrics.regression_metrics(numbers.apply(blind), "n_chars", "prediction", digits=4)
    return classes.select("*", F.lit(None).cast("double").alias("r2")).unionByName(
        fit.select(F.lit("adaboost regressor").alias("model"), "r2"), allowMissingColumns=True
    )


@query("bagging")
def bagging(spark, sf):
    df, features = labelled(spark, sf)
    bags = {
        "rows": ensembles.fit_bagging(df, features, "label", estimators=BAGS, row_share=0.8, depth=BAG_DEPTH),
        "rows and columns": ensembles.fit_bagging(df, features, "label", estimators=BAGS, column_share=0.6, column_sets=10, depth=BAG_DEPTH),
    }
    return together([scored(n, ensembles.apply_bagging(m, df)) for n, m in bags.items()])


@query(
    "knn_classify",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
       d AS (SELECT a.vec_id, a.label AS actual, b.label, b.vec_id AS other, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
       near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS place FROM d) WHERE place <= 5),
       ballots AS (SELECT vec_id, actual, label, count(*) AS n FROM near GROUP BY ALL)
       SELECT vec_id, actual, label AS prediction FROM (
         SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS r FROM ballots) WHERE r = 1""",
)
def knn_classify(spark, sf):
    """Every vector is classified by its five nearest other vectors."""
    v = table(spark, sf, "embeddings")
    near = neighbours.nearest_neighbours(v, v, "vec_id", "embedding", 5, "label", exclude_self=True)
    voted = neighbours.knn_vote(near)
    return v.select("vec_id", F.col("label").alias("actual")).join(voted.withColumnRenamed("qid", "vec_id"), "vec_id")


@query(
    "knn_grid",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
       pairs AS (SELECT a.vec_id, a.label AS actual, b.label, b.vec_id AS other, list_distance(a.e, b.e) AS d2,
                        list_sum(list_transform(list_zip(a.e, b.e), lambda x: abs(x[1] - x[2]))) AS d1 FROM v a JOIN v b ON a.vec_id <> b.vec_id),
       d AS (SELECT vec_id, actual, label, other, 1 AS p, d1 AS dist FROM pairs UNION ALL SELECT vec_id, actual, label, other, 2, d2 FROM pairs),
       near AS (SELECT *, row_number() OVER (PARTITION BY p, vec_id ORDER BY dist, other) AS place FROM d QUALIFY place <= 10),
       asked AS (SELECT * FROM near, (SELECT unnest([3, 5, 7, 10]) AS k), (SELECT unnest(['uniform', 'distance']) AS weights) WHERE place <= k),
       weighed AS (SELECT *, CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE WHEN min(dist) OVER (PARTITION BY p, k, weights, vec_id) = 0 THEN CAST(dist = 0 AS DOUBLE)
                                  ELSE 1 / dist END AS w FROM asked),
       ballots AS (SELECT p, k, weights, vec_id, actual, label, sum(w) AS w FROM weighed GROUP BY ALL),
       votes AS (SELECT *, row_number() OVER (PARTITION BY p, k, weights, vec_id ORDER BY w DESC, label) AS r FROM ballots)
       SELECT CAST(p AS INTEGER) AS p, CAST(k AS INTEGER) AS k, weights, count(*) AS n, count(*) FILTER (WHERE actual = label) AS hits
       FROM votes WHERE r = 1 GROUP BY ALL""",
)
def knn_grid(spark, sf):
    """How many vectors their neighbours classify rightly, for each distance, number and weighting of neighbours."""
    v = table(spark, sf, "embeddings")
    fitted = neighbours.fit_neighbours(v, "vec_id", "embedding", "label")
    actual = v.select(F.col("vec_id").alias("qid"), F.col("label").alias("actual"))
    out = []
    for p in (1, 2):
        near = store(fitted.nearest(v, "vec_id", "embedding", 10, p, exclude_self=True), "neighbours")
        for k in (3, 5, 7, 10):
            for weights in ("uniform", "distance"):
                voted = neighbours.knn_vote(near.where(F.col("place") <= k), weights).join(actual, "qid")
                row = voted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("actual") == F.col("prediction")).alias("hits"))
                out.append(row.select(F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(weights).alias("weights"), "n", "hits"))
    return together(out)


@query(
    "gaussian_nb",
    f"""WITH {TABULAR_SQL},
      s AS (SELECT greatest(var_pop(n_chars), var_pop(commas), var_pop(stops)) * 1e-9 AS lift, count(*) AS n FROM tabular),
      c AS (SELECT quality AS k, ln(count(*) / (SELECT n FROM s)) AS prior, avg(n_chars) AS m1, var_pop(n_chars) + (SELECT lift FROM s) AS v1,
                   avg(commas) AS m2, var_pop(commas) + (SELECT lift FROM s) AS v2, avg(stops) AS m3, var_pop(stops) + (SELECT lift FROM s) AS v3
            FROM tabular GROUP BY 1),
      l AS (SELECT doc_id, quality, k, prior - 0.5 * (ln(2 * pi() * v1) + ln(2 * pi() * v2) + ln(2 * pi() * v3))
              - (n_chars - m1) ** 2 / (2 * v1) - (commas - m2) ** 2 / (2 * v2) - (stops - m3) ** 2 / (2 * v3) AS w FROM tabular, c)
      SELECT doc_id, quality, k AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, k) AS r FROM l) WHERE r = 1""",
)
def gaussian_nb(spark, sf):
    t = store(tabular(spark, sf), "tabular")
    fitted = bayes.fit_gaussian_bayes(t, ["n_chars", "commas", "stops"], "quality")
    return fitted.apply(t).select("doc_id", "quality", "prediction")


_RULE_SQL = f"{TABULAR_SQL}, p AS (SELECT *, CAST(n_chars > 300 AND commas * 50 > stops AS INTEGER) AS guess FROM tabular)"


def ruled(spark, sf):
    rule = (F.col("n_chars") > 300) & (F.col("commas") * 50 > F.col("stops"))
    return tabular(spark, sf).withColumn("guess", rule.cast("int"))


@query(
    "classification_metrics",
    f"""WITH {_RULE_SQL}, c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND guess = 1) AS fp,
         count(*) FILTER (WHERE quality = 1 AND guess = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND guess = 0) AS tn FROM p GROUP BY 1)
      SELECT *, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
             round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def classification_metrics(spark, sf):
    return metrics.classification_metrics(ruled(spark, sf), "quality", "guess", by=["lang"])


@query(
    "class_report",
    f"""WITH {_RULE_SQL}, k AS (SELECT DISTINCT quality AS c FROM p UNION SELECT DISTINCT guess FROM p),
      n AS (SELECT CAST(c AS VARCHAR) AS class, count(*) FILTER (WHERE quality = c AND guess = c) AS hit, count(*) FILTER (WHERE guess = c) AS said,
                   count(*) FILTER (WHERE quality = c) AS support FROM p, k GROUP BY 1)
      SELECT class, round(hit / nullif(said, 0), 6) AS precision, round(hit / nullif(support, 0), 6) AS recall,
             round(2 * hit / nullif(said + support, 0), 6) AS f1, support FROM n""",
)
def class_report(spark, sf):
    return metrics.class_report(ruled(spark, sf), "quality", "guess")


@query(
    "regression_metrics",
    """WITH p AS (SELECT o_orderstatus, o_totalprice AS y, 200000 + 10 * (o_custkey % 1000) AS e FROM orders)
       SELECT o_orderstatus, count(*) AS n, round(1 - sum((y - e) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
              round(avg((y - e) ** 2) / 1e6, 4) AS mse, round(avg(abs(y - e)), 4) AS mae FROM p GROUP BY 1""",
)
def regression_metrics(spark, sf):
    p = table(spark, sf, "orders").withColumn("guess", 200000 + 10 * (F.col("o_custkey") % 1000))
    out = metrics.regression_metrics(p, "o_totalprice", "guess", by=["o_orderstatus"])
    return out.withColumns({"mse": F.round(F.col("mse") / 1e6, 4), "mae": F.round("mae", 4)})


@query("mlp_classifier")
def mlp_classifier(spark, sf):
    v, width = vectors(spark, sf)
    v = v.withColumn("label", F.col("label").cast("double"))
    classes = int(v.agg(F.max("label")).first()[0]) + 1
    net = models.classifier("net", layers=[width, 16, classes])
    predicted = models.fit(v, ["vec"], net).transform(v)
    return metrics.class_report(predicted, "label", "prediction", digits=4)


@query("multiclass_models")
def multiclass_models(spark, sf):
    """Several classes: multinomial regression, and boosted trees one class against the rest."""
    v, _ = vectors(spark, sf)
    v = store_for_fits(v.withColumn("label", F.col("label").cast("double")), "vectors")
    kinds = {"multinomial": {}, "boosting_multiclass": BOOSTING}
    out = []
    for kind, params in kinds.items():
        predicted = models.fit(v, ["vec"], models.classifier(kind, **params)).transform(v)
        out.append(metrics.class_report(predicted, "label", "prediction", digits=4).select(F.lit(kind).alias("model"), "*"))
    return together(out)


@query(
    "attached_predictions",
    """WITH f AS (SELECT regr_slope(ln(l_extendedprice), l_quantity) AS a, regr_intercept(ln(l_extendedprice), l_quantity) AS b FROM lineitem)
       SELECT l_orderkey AS "ID", round(exp(b + a * l_quantity), 4) AS prediction FROM lineitem, f""",
)
def attached_predictions(spark, sf):
    """A model of the log price; predictions back on the price scale, next to their ids."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.ln("l_extendedprice").alias("log_price"))
    model = models.fit(li, ["l_quantity"], models.regressor("linear", label="log_price"))
    predicted = models.attach_predictions(model, li, ["l_orderkey"], log_scale=True)
    rounded = predicted.withColumn("predicted", F.round("predicted", 4))
    return models.submission(rounded, "l_orderkey", "predicted", {"id": "ID", "value": "prediction"})


@query("ranked_importance")
def ranked_importance(spark, sf):
    df, features = labelled(spark, sf)
    parts = ensembles.grow(df, models.classifier("forest", **FOREST), df.count(), [VectorAssembler(inputCols=features, outputCol="features")])
    weights = models.weights_table(spark, ensembles.grown_importances(parts), features)
    return ranking.top_k_abs(weights, "weight", 5, "feature")
