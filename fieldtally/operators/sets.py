"""Union, distinct, and transforming two frames as one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union all by name; columns a frame lacks are missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def transform_together(
    train: DataFrame, test: DataFrame, step: Callable[[DataFrame], DataFrame], tag: str = "is_train"
) -> tuple[DataFrame, DataFrame]:
    """Tag, union, apply one step to both frames, split back by the tag."""
    both = bind_rows(train.withColumn(tag, F.lit(1)), test.withColumn(tag, F.lit(0)))
    out = step(both)
    return out.where(F.col(tag) == 1).drop(tag), out.where(F.col(tag) == 0).drop(tag)
