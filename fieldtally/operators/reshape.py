"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    values: Sequence[str],
    measures: Sequence[str],
    tie_key: Sequence[str],
) -> DataFrame:
    """One row per key and ``<measure>_<value>`` columns; the first row by ``tie_key`` wins."""
    aggs = [
        F.min_by(m, F.when(F.col(column) == v, F.struct(*tie_key))).alias(f"{m}_{v}")
        for v in values
        for m in measures
    ]
    return df.where(F.col(column).isin(list(values))).groupBy(*keys).agg(*aggs)


def to_long(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    names: Sequence[str],
    value: str,
    separator: str = "_",
) -> DataFrame:
    """Unpivot and split the column name; pieces beyond ``names`` are dropped."""
    long = df.unpivot(list(keys), list(columns), "__name", value)
    pieces = F.split("__name", separator)
    return long.select(*keys, *[F.get(pieces, F.lit(i)).alias(n) for i, n in enumerate(names)], value)


def fold_groups(df: DataFrame, groups: Mapping[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Add up groups of wide columns over all rows (or per key), skipping missing values."""
    sums = [
        sum((F.coalesce(F.sum(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.sum(cols[0]), F.lit(0))).alias(name)
        for name, cols in groups.items()
    ]
    return df.groupBy(*keys).agg(*sums)


def display_order(df: DataFrame, column: str, levels: Sequence[str], name: str = "sort_key") -> DataFrame:
    """Position of a value in a fixed list of levels."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(column)).cast("int")
    return df.withColumn(name, position)
