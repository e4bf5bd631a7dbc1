"""Ensembles Spark ML does not ship: AdaBoost, bagging of rows and columns, stacking."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import cut_lineage, store, store_for_fits
from .cell_forests import CellForest, forest_on_cells
from .models import DEEP
from .tuning import hash_fold


@dataclass
class Vote:
    """Weighted vote (classes) or weighted median (numbers) over fitted models."""

    models: list[Model]
    weights: list[float]
    classes: list[float] | None
    vector: str

    def apply(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        out = df
        names = []
        for i, model in enumerate(self.models):
            name = f"__p{i}"
            keep = [*out.columns, F.col("prediction").alias(name)]
            out = model.transform(out).select(*keep)
            names.append(name)
        choice = self._class_vote(names) if self.classes is not None else self._median(names)
        return out.withColumn(output, choice).drop(*names)

    def _class_vote(self, names) -> Column:
        totals = [
            sum((F.when(F.col(n) == c, w).otherwise(0.0) for n, w in zip(names, self.weights)), F.lit(0.0))
            for c in self.classes
        ]
        ballots = F.array(*[F.struct(t.alias("w"), F.lit(-i).alias("order"), F.lit(c).alias("c")) for i, (t, c) in enumerate(zip(totals, self.classes))])
        return F.array_max(ballots)["c"]

    def _median(self, names) -> Column:
        half = sum(self.weights) / 2
        pairs = F.array_sort(F.array(*[F.struct(F.col(n).alias("p"), F.lit(float(w)).alias("w")) for n, w in zip(names, self.weights)]))
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("pick"))
        walked = F.aggregate(
            pairs,
            start,
            lambda s, x: F.struct(
                (s["seen"] + x["w"]).alias("seen"),
                F.coalesce(s["pick"], F.when(s["seen"] + x["w"] >= half, x["p"])).alias("pick"),
            ),
        )
        return walked["pick"]


def fit_adaboost(
    train: DataFrame, label: str, vector: str = "features", rounds: int = 10, learning_rate: float = 1.0,
    depth: int = 1, seed: int = 1, cut_every: int = 5,
) -> Vote:
    """Discrete SAMME: each tree sees the rows its predecessors missed with more weight.

    The weights live in the table.  Every ``cut_every`` rounds the table is checkpointed, so
    neither the plan nor the recomputation after a lost executor grows with the rounds.
    """
    classes = sorted(float(r[0]) for r in train.select(F.col(label).cast("double")).distinct().limit(1001).collect())
    if len(classes) > 1000:
        raise ValueError("the label has more than 1000 classes")
    k = len(classes)
    frame = train.select(vector, F.col(label).cast("double").alias("__y"), F.lit(1.0).alias("__w"))
    models, weights = [], []
    for t in range(rounds):
        tree = DecisionTreeClassifier(labelCol="__y", featuresCol=vector, weightCol="__w", maxDepth=depth, seed=seed + t)
        model = tree.fit(frame)
        missed = (F.col("prediction") != F.col("__y")).cast("double")
        scored = model.transform(frame).select(vector, "__y", "__w", missed.alias("__miss"))
        row = scored.agg(F.sum(F.col("__w") * F.col("__miss")).alias("bad"), F.sum("__w").alias("all"), F.count(F.lit(1)).alias("n")).first()
        error = row["bad"] / row["all"]
        if error >= 1 - 1 / k:
            if not models:
                models, weights = [model], [1.0]
            break
        models.append(model)
        if error <= 0:
            weights.append(1.0)
            break
        alpha = learning_rate * (math.log((1 - error) / error) + math.log(k - 1))
        weights.append(alpha)
        lifted = F.col("__w") * F.exp(F.lit(alpha) * F.col("__miss"))
        # keep the mean weight at one so that it neither overflows nor vanishes
        norm = (row["all"] - row["bad"] + row["bad"] * math.exp(alpha)) / row["n"]
        frame = scored.select(vector, "__y", (lifted / norm).alias("__w"))
        if (t + 1) % cut_every == 0 and t + 1 < rounds:
            frame = cut_lineage(frame)
    return Vote(models, weights, classes, vector)


def fit_adaboost_regressor(
    train: DataFrame, label: str, vector: str = "features", rounds: int = 10, learning_rate: float = 1.0,
    depth: int = 3, seed: int = 1, cut_every: int = 5,
) -> Vote:
    """AdaBoost.R2 with linear loss; predictions combine by weighted median."""
    frame = train.select(vector, F.col(label).cast("double").alias("__y"), F.lit(1.0).alias("__w"))
    models, weights = [], []
    for t in range(rounds):
        tree = DecisionTreeRegressor(labelCol="__y", featuresCol=vector, weightCol="__w", maxDepth=depth, seed=seed + t)
        model = tree.fit(frame)
        scored = model.transform(frame).select(vector, "__y", "__w", F.abs(F.col("__y") - F.col("prediction")).alias("__e"))
        row = scored.agg(F.max("__e").alias("top"), F.sum(F.col("__w") * F.col("__e")).alias("bad"), F.sum("__w").alias("all"), F.count(F.lit(1)).alias("n")).first()
        if not row["top"]:
            models.append(model)
            weights.append(1.0)
            break
        loss = row["bad"] / row["top"] / row["all"]
        if loss >= 0.5:
            if not models:
                models, weights = [model], [1.0]
            break
        beta = loss / (1 - loss)
        models.append(model)
        weights.append(learning_rate * math.log(1 / beta))
        shrink = F.pow(F.lit(beta), F.lit(learning_rate) * (1 - F.col("__e") / row["top"]))
        lowered = scored.select(vector, "__y", (F.col("__w") * shrink).alias("__w"))
        total = lowered.agg(F.sum("__w")).first()[0]
        frame = lowered.withColumn("__w", F.col("__w") * (row["n"] / total))
        if (t + 1) % cut_every == 0 and t + 1 < rounds:
            frame = cut_lineage(frame)
    return Vote(models, weights, None, vector)


#: Rows times trees that are grown together.  The driver holds every node of a forest, up to two for each row and tree.
GROWN_AT_ONCE = 1_000_000


def forest_parts(trees: int, depth: int, rows: int) -> list[int]:
    """Numbers of trees that are grown together: all, or as many as the driver can hold (one at least)."""
    leaves = min(max(1, rows), 2**depth)
    size = max(1, min(trees, GROWN_AT_ONCE // leaves))
    return [min(size, trees - at) for at in range(0, trees, size)]


def grow(train: DataFrame, forest: Estimator, rows: int, before: Sequence = ()) -> Iterator[PipelineModel | CellForest]:
    """``forest`` as forests of fewer trees, one after the other, so that no more than :data:`GROWN_AT_ONCE` is held.

    A forest within the bound is fitted as it is.  A larger one for classes grows on cells (:class:`CellForest`), a few trees
    a task, if there are few enough of them.  The trees of a forest do not depend on each other; every part has
    its own seed and looks at as many columns in a split as the whole forest would.  ``before`` are stages ahead of it.
    """
    sizes = forest_parts(forest.getNumTrees(), forest.getMaxDepth(), rows)
    if len(sizes) > 1 and rows > CUT_ROWS and (on_cells := _on_cells(train, forest, before)):
        yield on_cells
        return
    if len(sizes) > 1:  # every row is looked at once a tree and level: all cores take part
        train = train.repartition(max(train.rdd.getNumPartitions(), train.sparkSession.sparkContext.defaultParallelism)).cache()
    strategy = forest.getFeatureSubsetStrategy()
    if len(sizes) > 1 and strategy == "auto":
        strategy = "sqrt" if isinstance(forest, RandomForestClassifier) else "onethird"
    for i, size in enumerate(sizes):
        part = forest.copy({forest.numTrees: size, forest.seed: forest.getSeed() + 1_000_003 * i, forest.featureSubsetStrategy: strategy})
        yield Pipeline(stages=[*before, part]).fit(train)
    if len(sizes) > 1:
        train.unpersist()


def _on_cells(train: DataFrame, forest: Estimator, before: Sequence) -> CellForest | None:
    """The forest on the bins that Spark would give its columns; None if Spark has to grow it, or to say what is wrong with the rows."""
    if not isinstance(forest, RandomForestClassifier) or len(before) != 1 or not isinstance(before[0], VectorAssembler):
        return None
    features = before[0].getInputCols()
    kinds = train.schema
    if forest.getMaxBins() != BINS or any(not isinstance(kinds[f].dataType, NumericType) or "ml_attr" in kinds[f].metadata for f in features):
        return None
    wrong = [F.coalesce(F.abs(F.col(f).cast("double")) >= math.inf, F.lit(True)) for f in features]  # no number is above all
    if train.where(reduce(lambda a, b: a | b, wrong)).limit(1).count():
        return None
    names = [f"__bin{i}" for i in range(len(features))]
    splits = _splits(cut_points(train, features, BINS))
    return forest_on_cells(train, forest, [Bucketizer(splitsArray=splits, inputCols=features, outputCols=names)], names, [len(s) - 1 for s in splits])


def grown_importances(parts: Iterable[PipelineModel | CellForest]) -> np.ndarray:
    """Importances of the forest that ``parts`` make up: the mean over its trees that split at all, as in one forest."""
    total: np.ndarray | float = 0.0
    for model in parts:
        forest = model.stages[-1]
        if isinstance(forest, CellForest):
            total = total + forest.importances(SparkSession.getActiveSession())
        else:
            total = total + forest.featureImportances.toArray() * sum(t.numNodes > 1 for t in forest.trees)
    return total / total.sum() if np.sum(total) else np.asarray(total)


def vote_of_parts(parts: Iterable[PipelineModel | CellForest], df: DataFrame, keep: Sequence[str], rows: int, output: str = "prediction") -> DataFrame:
    """``keep`` columns of ``df`` and the class that the trees of all parts choose together (largest sum of their class probabilities).

    Parts are forgotten once they have voted: the votes so far are stored whenever what was grown reaches the bound, so
    neither the driver nor a task holds more trees than that.
    """
    given = df.columns
    out, held, so_far, waiting = df, 0, None, []

    def counted(out: DataFrame, models: Sequence[PipelineModel | CellForest], so_far: str | None) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        names = []
        for i, model in enumerate(models):
            votes = vector_to_array(F.col("rawPrediction")).alias(f"__votes{i}")  # the sum over its trees
            out = model.transform(out).select(*given, *([so_far] if so_far else []), *names, votes)
            names.append(f"__votes{i}")
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), map(F.col, [*([so_far] if so_far else []), *names]))
        return out.select(*given, total.alias("__votes"))

    for model in parts:
        forest = model.stages[-1]
        leaves = forest.getNumTrees * min(max(1, rows), 2 ** forest.getMaxDepth())
        if waiting and held + leaves > GROWN_AT_ONCE:
            out = store(counted(out, waiting, so_far), "votes")
            so_far, held, waiting = "__votes", 0, []
        waiting.append(model)
        held += leaves
    out = counted(out, waiting, so_far)
    # first class with the largest total
    return out.select(*keep, (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double").alias(output))


#: Most combinations of bins for which trees are grown on cells: a few tasks hold that many rows.
CELLS = 2_000_000
#: Rows that cut points are taken from, as many as Spark's own trees look at for theirs.
CUT_ROWS = 10_000
#: Bins of a feature, as many as Spark's trees have if nothing else is said.
BINS = 32


def cut_points(train: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the thresholds among which trees of at most ``bins`` bins look for their splits.

    Halfway between neighbouring values; where there are more than ``bins`` values, after about every ``bins``-th part of
    the rows.  All rows up to :data:`CUT_ROWS` count, otherwise a repeatable sample of about so many: Spark's rule.
    """
    rows = train.count()
    x = train.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    if rows > CUT_ROWS:
        x = x.sample(CUT_ROWS / rows, seed=1)
    columns = np.array(x.collect(), dtype=float).reshape(-1, len(features)).T
    most = min(bins, max(1, rows)) - 1
    return [_cuts(*np.unique(c, return_counts=True), most) for c in columns]


def _cuts(values: np.ndarray, counts: np.ndarray, most: int) -> list[float]:
    halfway = ((values[:-1] + values[1:]) / 2).tolist()
    if len(halfway) <= most:
        return halfway
    stride = target = counts.sum() / (most + 1)
    out, seen = [], counts[0]
    for cut, count in zip(halfway, counts[1:]):
        if abs(seen - target) < abs(seen + count - target):
            out.append(cut)
            target += stride
        seen += count
    return out


def cells(train: DataFrame, bins: Sequence[str], label: str, weight: str) -> DataFrame:
    """One row per combination of ``bins``: the mean of ``label`` (missing if one is) and the number of rows.

    For trees that take every row as often as any other, this is the whole table: a split by bins is judged by sums
    over them, and the spread inside a cell is the same whatever the split.
    """
    n = F.count(F.lit(1))
    grouped = train.groupBy(*bins).agg(F.when(F.count(label) == n, F.avg(label)).alias(label), n.cast("double").alias(weight))
    return store_for_fits(grouped, "cells")


def class_cells(train: DataFrame, bins: Sequence[str], label: str, weight: str) -> DataFrame:
    """One row per combination of ``bins`` and ``label`` with the number of rows: the whole table for trees of classes, boosted or not.

    Rows of one cell and one class stay alike in every round of boosting.
    """
    grouped = train.groupBy(*bins, label).agg(F.count(F.lit(1)).cast("double").alias(weight))
    return store_for_fits(grouped, "cells")


def _splits(cuts: Sequence[Sequence[float]]) -> list[list[float]]:
    # a value on a threshold goes to the left in a tree, to the right in a Bucketizer, which wants one threshold at least
    return [[-math.inf, *np.nextafter(c or [0.0], math.inf).tolist(), math.inf] for c in cuts]


def fit_on_cells(train: DataFrame, features: Sequence[str], estimators: Mapping[str, Estimator], bins: int = BINS, vector: str = "features") -> dict[str, PipelineModel]:
    """Trees of numbers or classes, or boosted ones (with squared loss for numbers), on all rows of ``train`` by way of their cells.

    Each of the many short jobs of a fit then runs over the cells, whose number the rows do not raise beyond the
    combinations of bins.  Only for estimators that neither draw rows nor count them (``subsamplingRate`` 1,
    ``minInstancesPerNode`` 1); with too many combinations for numbers, or others, the rows themselves are fitted.  So are up
    to :data:`CUT_ROWS` rows if all estimators are for classes.
    """
    whole = [VectorAssembler(inputCols=list(features), outputCol=vector)]
    if all(est.hasParam("probabilityCol") for est in estimators.values()) and train.count() <= CUT_ROWS:
        return {name: Pipeline(stages=[*whole, est]).fit(train) for name, est in estimators.items()}
    splits = _splits(cut_points(train, features, bins))
    names = [f"__bin{i}" for i in range(len(features))]
    ahead = [Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=names), VectorAssembler(inputCols=names, outputCol=vector)]
    out: dict[str, PipelineModel] = {}
    small: dict[tuple[str, bool], DataFrame] = {}
    for name, est in estimators.items():
        label, classes = est.getLabelCol(), est.hasParam("probabilityCol")
        # there are no more cells of classes than rows, however many combinations
        many = not classes and math.prod(len(s) - 1 for s in splits) > CELLS
        if _counts_rows(est, classes) or est.getMaxBins() < bins or many:
            out[name] = Pipeline(stages=[*whole, est]).fit(train)
            continue
        if (label, classes) not in small:
            # numbers in order, as the values are: a Bucketizer marks its bins as categories, which trees split in any order
            binned = ahead[0].transform(train).withColumns({c: F.col(c).alias(c, metadata={}) for c in names})
            small[label, classes] = (class_cells if classes else cells)(binned, names, label, "__rows")
        model = est.copy({est.weightCol: "__rows"}).fit(ahead[1].transform(small[label, classes]))
        out[name] = PipelineModel(stages=[*ahead, model])
    for frame in small.values():
        frame.unpersist()
    return out


def _counts_rows(est: Estimator, classes: bool = False) -> bool:
    """Does it matter to the estimator how many rows a cell stands for, beyond their weight?"""
    drawn = est.hasParam("bootstrap") and est.getOrDefault("bootstrap")
    shared = est.hasParam("subsamplingRate") and est.getOrDefault("subsamplingRate") < 1
    other_loss = not classes and est.hasParam("lossType") and est.getOrDefault("lossType") != "squared"
    return bool(drawn or shared or other_loss) or est.getMinInstancesPerNode() > 1 or est.isDefined("weightCol") and bool(est.getOrDefault("weightCol"))


def _forest(kind: str, label: str, vector: str, **params) -> Estimator:
    make = RandomForestClassifier if kind == "classes" else RandomForestRegressor
    return make(labelCol=label, featuresCol=vector, cacheNodeIds=params.get("maxDepth", 5) >= DEEP, **params)


def fit_bagging(
    train: DataFrame, features: Sequence[str], label: str, kind: str = "classes", estimators: int = 10,
    row_share: float = 1.0, column_share: float = 1.0, depth: int = 5, seed: int = 1, column_sets: int | None = None,
) -> list[PipelineModel]:
    """Trees on bootstrapped rows and sampled columns.

    Trees that share a column set are grown together as one forest that looks at all its
    columns in every split, so ``estimators`` trees need only ``column_sets`` jobs.
    """
    rng = np.random.default_rng(seed)
    width = max(1, round(column_share * len(features)))
    sets = 1 if width == len(features) else min(column_sets or estimators, estimators)
    sizes = [estimators // sets + (1 if i < estimators % sets else 0) for i in range(sets)]
    models = []
    for i, size in enumerate(sizes):
        chosen = sorted(rng.choice(len(features), width, replace=False))
        stages = [
            VectorAssembler(inputCols=[features[j] for j in chosen], outputCol=f"__bag{i}"),
            _forest(kind, label, f"__bag{i}", numTrees=size, subsamplingRate=row_share, featureSubsetStrategy="all", maxDepth=depth, seed=seed + i)
            .setPredictionCol(f"__bagpred{i}"),
        ]
        models.append(Pipeline(stages=stages).fit(train))
    return models


def _mean_of_groups(models: Sequence[PipelineModel], df: DataFrame, prefix: str, kind: str, output: str) -> DataFrame:
    """Forests of several column sets or cuts combined: mean class probability, or mean."""
    from pyspark.ml.functions import vector_to_array

    out, parts, trees = df, [], []
    for i, model in enumerate(models):
        forest = model.stages[-1]
        source = vector_to_array(F.col("probability")) if kind == "classes" else F.col(forest.getPredictionCol())
        out = model.transform(out).select(*out.columns, source.alias(f"{prefix}{i}"))
        parts.append(f"{prefix}{i}")
        trees.append(float(forest.getNumTrees))
    if kind == "classes":
        total = F.transform(F.col(parts[0]), lambda p: p * trees[0])
        for name, n in zip(parts[1:], trees[1:]):
            total = F.zip_with(total, F.transform(F.col(name), lambda p, n=n: p * n), lambda a, b: a + b)
        # first class with the largest total
        choice = (F.array_position(total, F.array_max(total)) - 1).cast("double")
    else:
        choice = sum((F.col(p) * n for p, n in zip(parts, trees)), F.lit(0.0)) / sum(trees)
    return out.withColumn(output, choice).drop(*parts)


def apply_bagging(models: Sequence[PipelineModel], df: DataFrame, kind: str = "classes", output: str = "prediction") -> DataFrame:
    return _mean_of_groups(models, df, "__bagout", kind, output)


def fit_extra_trees(
    train: DataFrame, features: Sequence[str], label: str, kind: str = "classes", groups: int = 5, trees: int = 10,
    cuts: int = 16, depth: int = 5, seed: int = 1, bootstrap: bool = False, **params,
) -> list[PipelineModel | CellForest]:
    """Forests whose candidate split points are random instead of searched.

    Each group of trees first cuts every feature at points drawn uniformly from its range
    (one aggregate gives the ranges), so its trees can only split there.  Numbers whose rows are not drawn are fitted on
    the :func:`cells` of these cuts, drawn rows of classes above :data:`CUT_ROWS` grow as a :class:`CellForest`.
    """
    rng = np.random.default_rng(seed)
    row = train.agg(*[F.min(f).cast("double").alias(f"lo{i}") for i, f in enumerate(features)], *[F.max(f).cast("double").alias(f"hi{i}") for i, f in enumerate(features)], F.count(F.lit(1)).alias("rows")).first()
    models = []
    for g in range(groups):
        splits = []
        for i in range(len(features)):
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            inner = sorted(set(rng.uniform(lo, hi, cuts).tolist())) if hi > lo else [lo]
            splits.append([-math.inf, *inner, math.inf])
        cut_names = [f"__cut{g}_{i}" for i in range(len(features))]
        ahead = [
            Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=cut_names, handleInvalid="keep"),
            VectorAssembler(inputCols=cut_names, outputCol=f"__cuts{g}"),
        ]
        forest = _forest(kind, label, f"__cuts{g}", numTrees=trees, maxDepth=depth, seed=seed + g, bootstrap=bootstrap, maxBins=max(32, cuts + 2), **params)
        forest = forest.setPredictionCol(f"__cutpred{g}")
        # one more bin each for values that are no number
        if kind == "classes" and row["rows"] > CUT_ROWS and (on_cells := forest_on_cells(train, forest, ahead[:1], cut_names, [len(s) for s in splits], categories=True)):
            models.append(on_cells)
        elif kind == "numbers" and not _counts_rows(forest) and math.prod(len(s) for s in splits) <= CELLS:
            few = cells(ahead[0].transform(train), cut_names, label, "__rows")
            forest = forest.copy({forest.weightCol: "__rows"}).fit(ahead[1].transform(few))
            few.unpersist()
            models.append(PipelineModel(stages=[*ahead, forest]))
        else:
            models.append(Pipeline(stages=[*ahead, forest]).fit(train))
    return models


def apply_extra_trees(models: Sequence[PipelineModel], df: DataFrame, kind: str = "classes", output: str = "prediction") -> DataFrame:
    return _mean_of_groups(models, df, "__cutout", kind, output)


@dataclass
class ExtraTreesModel:
    models: Sequence[PipelineModel]
    kind: str

    def transform(self, df: DataFrame) -> DataFrame:
        return apply_extra_trees(self.models, df, self.kind)


@dataclass
class ExtraTrees:
    """:func:`fit_extra_trees` in the shape of an estimator, so that it can be a base model of a stack."""

    features: Sequence[str]
    label: str
    kind: str = "classes"
    params: Mapping[str, object] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> ExtraTreesModel:
        return ExtraTreesModel(fit_extra_trees(train, self.features, self.label, self.kind, **self.params), self.kind)


@dataclass
class Stack:
    base: Mapping[str, PipelineModel]
    final: PipelineModel

    def with_base(self, df: DataFrame) -> DataFrame:
        return _base_columns(self.base, df)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.final.transform(self.with_base(df))


def _base_columns(base: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    out = df
    for name, model in base.items():
        out = model.transform(out).select(*out.columns, F.col("prediction").alias(name))
    return out


def fit_stack(
    train: DataFrame, base: Mapping[str, Estimator], features: Sequence[str], final: Estimator,
    id_column: str | None = None, folds: int = 0, final_features: str = "__stack",
) -> Stack:
    """Base predictions become columns for a second-level model.

    With ``folds=0`` the second level learns from in-sample predictions.  With ``folds > 1``
    each training row is predicted by models that did not see it, which needs ``id_column``.
    """
    models = {name: est.fit(train) for name, est in base.items()}
    if folds > 1:
        tagged = train.withColumn("__fold", hash_fold(id_column, folds))
        pieces = []
        for f in range(folds):
            seen = tagged.where(F.col("__fold") != f)
            held = tagged.where(F.col("__fold") == f)
            pieces.append(_base_columns({n: e.fit(seen) for n, e in base.items()}, held).drop("__fold"))
        level2 = pieces[0]
        for piece in pieces[1:]:
            level2 = level2.unionByName(piece)
        level2 = cut_lineage(level2)
    else:
        level2 = _base_columns(models, train)
    stages = [VectorAssembler(inputCols=[*features, *base], outputCol=final_features), final.setFeaturesCol(final_features)]
    return Stack(models, Pipeline(stages=stages).fit(level2))
