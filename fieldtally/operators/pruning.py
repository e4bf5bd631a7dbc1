"""Dropping columns and rows by how much of them is missing.

Column choice depends on the data, so it takes two passes: one aggregate over all columns
(a single row comes back), then a plain projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import null_share


def column_null_shares(df: DataFrame) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return {c: row[c] or 0.0 for c in df.columns}


def prune_columns(df: DataFrame, max_share: float, inclusive: bool = True) -> DataFrame:
    """Keep columns whose missing share is at most (or, exclusive, below) ``max_share``."""
    shares = column_null_shares(df)
    keep = [c for c, s in shares.items() if s < max_share or (inclusive and s == max_share)]
    return df.select(*keep)


def prune_rows(df: DataFrame, max_share: float) -> DataFrame:
    return df.where(null_share(df.columns) <= max_share)


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def null_profile(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row per column: missing count and share, in one scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(F.col(c)).alias(c) for c in df.columns],
    )
    long = counts.unpivot(["__rows"], df.columns, "column_name", "present")
    return long.select(
        "column_name",
        (F.col("__rows") - F.col("present")).alias("missing"),
        F.round(
            F.try_divide((F.col("__rows") - F.col("present")).cast("double"), F.col("__rows").cast("double")),
            digits,
        ).alias("missing_share"),
    )
