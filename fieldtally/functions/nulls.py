"""Missing-value rules shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, missing where b is zero (plain division raises under ANSI mode)."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def differs_or_null(c: str | Column, value) -> Column:
    """Keep rows that differ from ``value`` and rows where the column is missing."""
    return (as_col(c) != F.lit(value)) | as_col(c).isNull()


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def strict_greatest(*cols: str | Column) -> Column:
    """Row-wise maximum that is missing as soon as one input is missing."""
    cols = tuple(as_col(c) for c in cols)
    any_null = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return F.when(~any_null, F.greatest(*cols))


def strict_sum(c: str | Column) -> Column:
    """Aggregate sum that is missing as soon as one input is missing."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def column_total(cols: list[str | Column], skip_null: bool = False) -> Column:
    """Fold several columns of a row into one sum."""
    cols = [as_col(c) for c in cols]
    if skip_null:
        cols = [F.coalesce(c, F.lit(0)) for c in cols]
    return reduce(lambda a, b: a + b, cols)


def null_share(cols: list[str]) -> Column:
    """Share of the listed columns that are missing in a row."""
    return column_total([F.col(c).isNull().cast("int") for c in cols]) / F.lit(float(len(cols)))
