"""Estimators by name, fitted as Spark ML pipelines, and what is read off them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import RFormula, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import numpy as np
import pandas as pd

#: From this depth on a forest keeps each row's nodes.  Otherwise all trees so far go to every task at every level,
#: which costs the driver time and memory; the trees are the same.
DEEP = 10


def classifier(kind: str, label: str = "label", features: str = "features", seed: int = 1, parallelism: int = 4, **params) -> Estimator:
    """Classifiers by the name of their family.

    Boosting libraries all map to gradient-boosted trees; margin learners to a linear SVC.
    ``parallelism`` counts the classes that ``boosting_multiclass`` fits at the same time.
    """
    common = {"labelCol": label, "featuresCol": features}
    if kind == "logistic":
        return LogisticRegression(**common, **params)
    if kind == "multinomial":
        return LogisticRegression(family="multinomial", **common, **params)
    if kind == "margin":
        return LinearSVC(**common, **params)
    if kind == "tree":
        return DecisionTreeClassifier(seed=seed, **common, **params)
    if kind == "forest":
        return RandomForestClassifier(seed=seed, cacheNodeIds=params.get("maxDepth", 5) >= DEEP, **common, **params)
    if kind == "boosting":
        return GBTClassifier(seed=seed, **common, **params)
    if kind == "boosting_multiclass":
        return OneVsRest(classifier=GBTClassifier(seed=seed, **params), parallelism=parallelism, **common)
    if kind == "net":
        return MultilayerPerceptronClassifier(seed=seed, **common, **params)
    raise ValueError(f"unknown classifier {kind!r}")


def regressor(kind: str, label: str = "label", features: str = "features", seed: int = 1, **params) -> Estimator:
    common = {"labelCol": label, "featuresCol": features}
    if kind == "linear":
        return LinearRegression(**common, **params)
    if kind == "elastic_net":
        return LinearRegression(**{"elasticNetParam": 0.75, "regParam": 0.0025, **common, **params})
    if kind == "tree":
        return DecisionTreeRegressor(seed=seed, **common, **params)
    if kind == "forest":
        return RandomForestRegressor(seed=seed, cacheNodeIds=params.get("maxDepth", 5) >= DEEP, **common, **params)
    if kind == "boosting":
        return GBTRegressor(seed=seed, **common, **params)
    raise ValueError(f"unknown regressor {kind!r}")


def fit(train: DataFrame, features: Sequence[str], estimator: Estimator, vector: str = "features") -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol=vector), estimator]).fit(train)


def fit_formula(train: DataFrame, formula: str, **params) -> PipelineModel:
    """Elastic net on an R-style formula, so text columns and interactions can be written out."""
    return Pipeline(
        stages=[RFormula(formula=formula, handleInvalid="keep"), regressor("elastic_net", **params)]
    ).fit(train)


def fit_ridge_classifier(train: DataFrame, features: Sequence[str], label: str, strength: float = 1.0):
    """Least squares with an L2 penalty on labels coded -1 / +1; the sign decides."""
    signed = train.withColumn("__signed", F.when(F.col(label) == 1, 1.0).otherwise(-1.0))
    estimator = regressor("linear", label="__signed", elasticNetParam=0.0, regParam=strength).setPredictionCol("__margin")
    return fit(signed, features, estimator)


def apply_ridge_classifier(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prediction", (F.col("__margin") > 0).cast("double"))


def least_squares(df: DataFrame, label: str, feature: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """One-feature least squares as running sums: slope, intercept and R2."""
    return df.groupBy(*by).agg(
        F.round(F.regr_slope(label, feature), digits).alias("slope"),
        F.round(F.regr_intercept(label, feature), digits).alias("intercept"),
        F.round(F.regr_r2(label, feature), digits).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def kernel_features(
    df: DataFrame, columns: Sequence[str], gamma: float, size: int = 200, seed: int = 1, output: str = "kernel_features"
) -> DataFrame:
    """Random Fourier features of the kernel exp(-gamma * |x - y|^2) (Rahimi and Recht, 2007).

    A linear model on them stands in for a kernel machine at linear cost.  One matrix product a batch; the
    matrix of ``size`` x columns goes to every task once.
    """
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2 * gamma), (size, len(columns))).T
    shifts = rng.uniform(0.0, 2 * np.pi, size)

    @F.pandas_udf("array<double>")
    def waves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            x = np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(columns)))
            yield pd.Series(list(np.sqrt(2.0 / size) * np.cos(x @ weights + shifts)))

    x = F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(output, array_to_vector(waves(x)))


def ranked_weights(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    """Coefficients or importances next to their feature names (one row per feature)."""
    vector = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return weights_table(spark, vector.toArray(), features)


def weights_table(spark: SparkSession, weights: Sequence[float], features: Sequence[str]) -> DataFrame:
    rows = [(name, float(v)) for name, v in zip(features, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double")


def attach_predictions(model: Model, df: DataFrame, ids: Sequence[str], log_scale: bool = False, name: str = "predicted") -> DataFrame:
    """Predictions beside their row's ids; ``log_scale`` undoes a log target."""
    value = F.exp("prediction") if log_scale else F.col("prediction")
    return model.transform(df).select(*ids, value.alias(name))


def submission(df: DataFrame, id_column: str, value: str, names: Mapping[str, str]) -> DataFrame:
    return df.select(F.col(id_column).alias(names["id"]), F.col(value).alias(names["value"]))
