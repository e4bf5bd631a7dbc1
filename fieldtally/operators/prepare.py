"""Learn-then-apply preparation: imputation, scaling, one-hot, PCA, products, time split.

``fit`` runs one aggregate on the training rows and keeps a small fitted dictionary;
``apply`` is a projection, so test rows see only training statistics.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_ratio
from .profile import exact_medians, modes


@dataclass
class Imputation:
    values: Mapping[str, object]

    def apply(self, df: DataFrame) -> DataFrame:
        known = {c: v for c, v in self.values.items() if v is not None and c in df.columns}
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items()})


def fit_mean_impute(train: DataFrame, columns: Sequence[str]) -> Imputation:
    return Imputation(train.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict())


def fit_median_impute(train: DataFrame, columns: Sequence[str]) -> Imputation:
    return Imputation(exact_medians(train, columns))


def fit_mode_impute(train: DataFrame, columns: Sequence[str]) -> Imputation:
    return Imputation(modes(train, columns))


@dataclass
class Scaling:
    mean: Mapping[str, float]
    sd: Mapping[str, float]

    def apply(self, df: DataFrame, digits: int | None = None) -> DataFrame:
        def score(c):
            z = safe_ratio(F.col(c) - F.lit(self.mean[c]), F.lit(self.sd[c]))
            return z if digits is None else F.round(z, digits)

        return df.withColumns({c: score(c) for c in self.mean})


def fit_standardize(train: DataFrame, columns: Sequence[str], ddof: int = 0) -> Scaling:
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[spread(c).alias(f"s_{c}") for c in columns]
    ).first()
    # a constant column scales to zero, not to missing
    return Scaling({c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] or 1.0 for c in columns})


@dataclass
class OneHot:
    levels: Mapping[str, list[str]] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.levels.items() for v in vs[1:]]

    def apply(self, df: DataFrame) -> DataFrame:
        """Indicator per level but the first; an absent or unseen level is all zeros."""
        flags = {
            f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, vs in self.levels.items() for v in vs[1:]
        }
        return df.withColumns(flags).drop(*self.levels)


def fit_onehot(df: DataFrame, columns: Sequence[str], max_levels: int = 10_000) -> OneHot:
    """Sorted levels per column.  More than ``max_levels`` is an error, not a silent cut."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("s"))
    found = long.select("s.*").where("v is not null").distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"more than {max_levels} levels: not a categorical column")
    return OneHot({c: sorted(r["v"] for r in found if r["c"] == c) for c in columns})


@dataclass
class Components:
    """Principal directions with a fixed sign: the largest loading of each is positive."""

    columns: list[str]
    model: PipelineModel
    signs: list[float]
    stretch: float
    loadings: list[list[float]]
    explained: list[float]

    def apply(self, df: DataFrame, prefix: str = "PC") -> DataFrame:
        out = self.model.transform(df).withColumn("__s", vector_to_array("__s"))
        scores = [
            (F.get("__s", F.lit(i)) * F.lit(sign * self.stretch)).alias(f"{prefix}{i + 1}") for i, sign in enumerate(self.signs)
        ]
        return out.select(*df.columns, *scores)


def fit_pca(df: DataFrame, columns: Sequence[str], k: int, scale: bool = True, center: bool = True) -> Components:
    """k principal directions by Spark ML, whose only driver-side matrix is columns x columns.

    ``scale`` standardises with the population sd; Spark's scaler uses the sample sd, which
    stretches all scores alike and is undone on them.  ``center=False`` finds the directions
    of the raw second moments: rows together with their mirror images have mean zero.
    ``columns`` may be numbers or whole vectors.
    """
    columns = list(columns)
    assemble_step = VectorAssembler(inputCols=columns, outputCol="__v")
    stretch, steps, source = 1.0, [assemble_step], "__v"
    if scale or center:
        scaler = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=scale)
        steps, source = [assemble_step, scaler], "__z"
    if scale:
        n = df.count()
        stretch = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    prepared = Pipeline(stages=steps).fit(df)
    ready = prepared.transform(df).select(F.col(source).alias("__in"))
    if not (scale or center):
        first = ready.first()
        flip = ElementwiseProduct(scalingVec=Vectors.dense([-1.0] * (len(first["__in"]) if first else len(columns))), inputCol="__in", outputCol="__out")
        ready = ready.unionByName(flip.transform(ready).select(F.col("__out").alias("__in")))
    model = PCA(k=k, inputCol="__in", outputCol="__s").fit(ready)
    model = model.setInputCol(source)
    loadings, signs = [], []
    for column in model.pc.toArray().T.tolist():
        sign = -1.0 if max(column, key=abs) < 0 else 1.0
        signs.append(sign)
        loadings.append([sign * x for x in column])
    chain = PipelineModel(stages=[*prepared.stages, model])
    return Components(columns, chain, signs, stretch, loadings, model.explainedVariance.toArray().tolist())


def pairwise_products(df: DataFrame, pairs: Sequence[str] | None = None, columns: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Products named "a|b": the listed pairs, or every pair of ``columns``; one projection."""
    names = list(pairs) if pairs is not None else [f"{a}|{b}" for a, b in combinations(columns, 2)]

    def product(name):
        a, b = name.split("|")
        out = F.col(a) * F.col(b)
        return (out if digits is None else F.round(out, digits)).alias(name)

    return df.select("*", *[product(n) for n in names])


def interaction_names(names: Sequence[str]) -> list[str]:
    """Names that are products (hold a literal bar)."""
    return [n for n in names if "|" in n]


def latest_period(df: DataFrame, year: str, week: str, ahead: int = 1) -> dict[str, int]:
    """Last year and, in it, the last period plus ``ahead``: one aggregate row."""
    row = df.agg(F.max(F.struct(year, week)).alias("last")).first()["last"]
    return {"year": row[0], "week": row[1] + ahead}


def time_split(df: DataFrame, target: Mapping[str, int], year: str = "year", week: str = "week") -> tuple[DataFrame, DataFrame]:
    """Train on everything before the target period, test on it; later rows are in neither."""
    earlier = (F.col(year) != target["year"]) | (F.col(week) < target["week"])
    at_target = (F.col(year) == target["year"]) & (F.col(week) == target["week"])
    return df.where(earlier), df.where(at_target)


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(df)


def sample_scaled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Spark ML's own scaler (sample sd) on an assembled vector, as ``array<double>``."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__v"),
        StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True),
    ]
    out = Pipeline(stages=stages).fit(df).transform(df)
    return out.withColumn("scaled", vector_to_array("__s")).drop("__v", "__s")
