"""Cross-validation over a parameter grid.

Folds come from a hash of the row id, not from a random generator: a row recomputed after
an executor loss lands in the same fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_fold(id_column: str, folds: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(folds)).cast("int")


def param_grid(estimator: Estimator, grid: Mapping[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(estimator, name), list(values))
    return builder.build()


def grid_search(
    df: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    evaluator: Evaluator,
    id_column: str,
    folds: int = 5,
    seed: int = 0,
    parallelism: int = 4,
    stages: Sequence = (),
) -> CrossValidatorModel:
    maps = param_grid(estimator, grid)
    validator = CrossValidator(
        estimator=Pipeline(stages=[*stages, estimator]),
        estimatorParamMaps=maps,
        evaluator=evaluator,
        numFolds=folds,
        foldCol="__fold",
        parallelism=parallelism,
    )
    return validator.fit(df.withColumn("__fold", hash_fold(id_column, folds, seed)))


def repeated_search(df: DataFrame, repeats: int, **settings) -> list[CrossValidatorModel]:
    """The same grid under several fold assignments."""
    return [grid_search(df, seed=seed, **settings) for seed in range(repeats)]


def results_table(models: Sequence[CrossValidatorModel], digits: int = 6) -> DataFrame:
    """One row per grid point and repeat: its parameters and mean score."""
    rows = []
    for repeat, model in enumerate(models):
        for params, score in zip(model.getEstimatorParamMaps(), model.avgMetrics):
            text = ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name))
            rows.append((repeat, text, round(float(score), digits)))
    return SparkSession.getActiveSession().createDataFrame(rows, "repeat int, params string, score double")
