"""Join shapes.

No side is force-broadcast.  Spark broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (adaptive execution re-checks it at run time) and
otherwise shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_attach(
    df: DataFrame, other: DataFrame, keys: Sequence[str] | Mapping[str, str]
) -> DataFrame:
    """Left join; a mapping joins ``df``'s key to a differently named key of ``other``."""
    if isinstance(keys, Mapping):
        other = other.withColumnsRenamed({right: left for left, right in keys.items()})
        keys = list(keys)
    return df.join(other, list(keys), "left")


def inner_match(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "inner")


def keep_matching(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members.select(*keys), list(keys), "left_semi")


def drop_matching(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members.select(*keys), list(keys), "left_anti")


def null_safe_left(
    df: DataFrame, other: DataFrame, keys: Sequence[str], null_safe: Iterable[str]
) -> DataFrame:
    """Left join where the ``null_safe`` keys also match missing with missing."""
    null_safe = set(null_safe)
    right = other.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b,
        [
            F.col(k).eqNullSafe(F.col(f"__right_{k}")) if k in null_safe else F.col(k) == F.col(f"__right_{k}")
            for k in keys
        ],
    )
    return df.join(right, condition, "left").drop(*[f"__right_{k}" for k in keys])


def having_members(df: DataFrame, keys: Sequence[str], condition: Column, *aggs: Column) -> DataFrame:
    """Rows of the groups whose aggregate passes ``condition``."""
    passing = df.groupBy(*keys).agg(*aggs).where(condition)
    return keep_matching(df, passing, keys)


def calendar_grid(df: DataFrame, entity: Sequence[str], period: str, first: int, last: int) -> DataFrame:
    """Every distinct entity once per period: the periods are generated inside each row."""
    periods = F.sequence(F.lit(first), F.lit(last))
    return df.select(*entity).distinct().select(*entity, F.explode(periods).alias(period))


def densify(
    df: DataFrame,
    entity: Sequence[str],
    period: str,
    first: int,
    last: int,
    zero_fill: Sequence[str] = (),
    null_safe: Iterable[str] = (),
) -> DataFrame:
    """Attach the facts to a dense entity x period grid and zero-fill the listed flags."""
    grid = calendar_grid(df, entity, period, first, last)
    facts = df.withColumn(period, F.col(period).cast("int"))
    out = null_safe_left(grid, facts, [*entity, period], null_safe)
    return out.fillna(0, subset=list(zero_fill)) if zero_fill else out


def partner_rows(
    df: DataFrame,
    entity: str,
    partner: str,
    period: Sequence[str],
    columns: Sequence[str],
    suffix: str = "_opponent",
) -> DataFrame:
    """Each row next to its partner's row of the same period.

    ``(entity, *period)`` must identify a row, so the join adds no rows; a missing partner
    keeps its row with missing partner columns.
    """
    right = df.select(
        F.col(entity).alias(partner),
        *period,
        *[F.col(c).alias(f"{c}{suffix}") for c in columns],
    )
    return df.join(right, [partner, *period], "left")
