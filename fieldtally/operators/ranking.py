"""Top-n, ranks with ties, first rows per key.

``rank() <= n`` and ``row_number() = 1`` filters are applied inside every input partition
before the shuffle (Spark's window group limit), so a hot group ships only its leaders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import store
from .prefix import ROWS_PER_TASK, prefix_sums


def top_n(df: DataFrame, n: int, order: Sequence[Column], group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """The n best rows, per group if asked, keeping every row tied with the n-th."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.rank().over(w)).where(F.col(name) <= n)


def top_n_cut(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Exactly n rows; ``order`` must break ties."""
    return df.orderBy(*order).limit(n)


def top_k_abs(df: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    return top_n_cut(df, k, [F.abs(column).desc(), F.col(tie).asc()])


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must be unique within a key."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def at_group_min(df: DataFrame, group: Sequence[str], column: str, null_empties_group: bool = False) -> DataFrame:
    """Rows holding their group's minimum.

    The minimum is aggregated and joined back on (group, value).  With
    ``null_empties_group`` a group with any missing value yields no rows.
    """
    minima = df.groupBy(*group).agg(
        F.min(column).alias(column),
        F.count(column).alias("__known"),
        F.count(F.lit(1)).alias("__all"),
    )
    if null_empties_group:
        minima = minima.where(F.col("__known") == F.col("__all"))
    return df.join(minima.select(*group, column), [*group, column], "left_semi")


def average_ranks(df: DataFrame, column: str, name: str, blocks: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rank over the whole table, largest first, tied rows sharing their average rank.

    Equal values are counted first, so a value shared by many rows is one row.  The distinct values are dealt by ranges
    of about ``rows_per_task`` (or into ``blocks`` ranges), the counts are summed up over them, and the ranks are joined
    back by value; no task sorts the whole table.  Missing values get no rank.  ``df`` is read twice: store it
    first if it is costly.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    counted = store(counted, "rank-counts")
    upto = prefix_sums(counted, [], [F.col(column).desc()], {"__upto": "__n"}, rows_per_task, blocks)
    ranked = upto.select(column, (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranked, column, "left")


def panel_order(df: DataFrame, panel: Sequence[str], order: Sequence[Column], name: str = "sort_key") -> DataFrame:
    """Position of a row inside its (already reduced) panel."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*panel).orderBy(*order)))
