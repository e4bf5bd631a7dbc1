"""The last stages of poll prediction: pruning, components, split, stacked models, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.feature import RFormula, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import numeric_columns
from ..operators.ensembles import ExtraTrees, fit_stack
from ..operators.models import kernel_features, regressor
from ..operators.prepare import fit_onehot, fit_pca, fit_standardize, time_split
from ..operators.pruning import complete_rows, prune_columns
from ..session import store, store_for_fits
from .poll import IDENTITY, KEYS, MODEL_COLUMNS, TARGET
from .report import compare_ranks


@dataclass(frozen=True)
class Settings:
    # Tuning values of the published models: fixed values
    null_limit: float = 0.2
    components: int = 6
    boost_a: Mapping[str, object] = field(default_factory=lambda: {"maxIter": 50, "maxDepth": 4, "stepSize": 0.15, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.75"})
    boost_b: Mapping[str, object] = field(default_factory=lambda: {"maxIter": 250, "maxDepth": 5, "stepSize": 0.04, "minInstancesPerNode": 4})
    # 500 trees with random split points, in groups that share their points
    forest: Mapping[str, object] = field(default_factory=lambda: {"groups": 10, "trees": 50, "featureSubsetStrategy": "10", "minInstancesPerNode": 10, "depth": 12})
    net: Mapping[str, object] = field(default_factory=lambda: {"elasticNetParam": 0.75, "regParam": 0.0025})
    kernel_gamma: float = 0.00325
    kernel_size: int = 400
    kernel_penalty: float = 1.0 / 3
    final: Mapping[str, object] = field(default_factory=lambda: {"numTrees": 500, "featureSubsetStrategy": "all", "minInstancesPerNode": 10, "maxDepth": 12})
    report_cut: int = 25
    folds: int = 0


def quick(settings: Settings | None = None) -> Settings:
    """Far fewer trees: for trying the plan out."""
    s = settings or Settings()
    few = {"numTrees": 20, "maxDepth": 6}
    few_random = {"groups": 4, "trees": 5, "depth": 6}
    return replace(
        s, boost_a={**s.boost_a, "maxIter": 5}, boost_b={**s.boost_b, "maxIter": 5}, forest={**s.forest, **few_random},
        final={**s.final, **few}, kernel_size=64,
    )


def model_table(features: DataFrame, settings: Settings = Settings(), components_from: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Prune sparse columns, keep complete rows, add component scores, project the model's columns.

    Returns the table and its feature names.  Columns lost to pruning are left out.
    """
    stored = store(features, "features")
    pruned = complete_rows(prune_columns(stored, settings.null_limit, inclusive=False))
    kept = set(pruned.columns)
    source = [c for c in (components_from or numeric_columns(pruned, IDENTITY)) if c in kept]
    k = min(settings.components, len(source))
    chosen = [c for c in MODEL_COLUMNS if c in kept]
    with_scores = fit_pca(pruned, source, k).apply(pruned)
    names = [*chosen, *[f"PC{i + 1}" for i in range(k)]]
    return with_scores.select(*KEYS, "analytical_votes", TARGET, *[F.col(n).cast("double").alias(n) for n in names]), names


def _interactions(terms: Sequence[str]) -> list[str]:
    return [":".join(c) for size in range(2, len(terms) + 1) for c in combinations(terms, size)]


def predict_poll(table: DataFrame, names: Sequence[str], target: Mapping[str, int], settings: Settings = Settings()) -> DataFrame:
    """Train on the weeks before the target, predict the target week: team, votes, prediction.

    Team, year and week are predictors of every model besides ``names``; a team is a set of indicators.
    """
    known = fit_onehot(time_split(table, target)[0], ["team"])
    inputs = {f"__x{i}": F.col(c).cast("double") for i, c in enumerate(["year", "week", *names])}
    indicators = {name: f"__t{i}" for i, name in enumerate(known.names())}  # a team's name may hold anything
    coded = known.apply(table.withColumns({**inputs, "__team": F.col("team")})).withColumnsRenamed({**indicators, "__team": "team"})
    predictors = [*inputs, *indicators.values()]
    z = [f"__z_{c}" for c in predictors]
    # standardised copies feed the kernel; the plain columns feed the trees
    scaled = fit_standardize(time_split(coded, target)[0], predictors).apply(coded.select("*", *[F.col(c).alias(f"__k_{c}") for c in predictors]))
    renamed = scaled.withColumnsRenamed({c: f"__z_{c}" for c in predictors}).withColumnsRenamed({f"__k_{c}": c for c in predictors})
    ready = store_for_fits(kernel_features(renamed, z, settings.kernel_gamma, settings.kernel_size, output="__kernel").drop(*z), "model-input")
    train, test = time_split(ready, target)

    def trees(kind, params):
        return Pipeline(stages=[VectorAssembler(inputCols=predictors, outputCol="features"), regressor(kind, label=TARGET, **params)])

    crossed = _interactions(["team", "year", "week", "lag_log_votes"])
    formula = f"{TARGET} ~ " + " + ".join(["team", "year", "week", *names, *crossed])
    base = {
        "boost_a": trees("boosting", settings.boost_a),
        "kernel": regressor("linear", label=TARGET, features="__kernel", elasticNetParam=0.0, regParam=settings.kernel_penalty / max(1, settings.kernel_size)),
        "boost_b": trees("boosting", settings.boost_b),
        "forest": ExtraTrees(predictors, TARGET, "numbers", settings.forest),
        "net": Pipeline(stages=[RFormula(formula=formula, featuresCol="__formula", labelCol="__formula_label", handleInvalid="keep"),
                                regressor("linear", label=TARGET, features="__formula", **settings.net)]),
    }
    train = train.withColumn("__id", F.concat_ws("|", *KEYS))
    stack = fit_stack(train, base, predictors, regressor("forest", label=TARGET, **settings.final), id_column="__id", folds=settings.folds)
    return stack.apply(test).select(*KEYS, "analytical_votes", F.exp("prediction").alias("predicted_votes"))


def rank_report(predicted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return compare_ranks(predicted, KEYS, "predicted_votes", "analytical_votes", settings.report_cut)
