"""Running totals, lags and group standardisation.

Windows run over rows already aggregated to one row per entity and period, so a partition
holds at most one entity's calendar.  Statistics of raw groups are aggregated with map-side
combining and joined back instead of being windowed, because a raw group may be huge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import safe_ratio, zero_if_null
from .prefix import ROWS_PER_TASK, prefix_sums


def season_window(entity: Sequence[str], order: Sequence[str]):
    """The one window spec shared by running totals and lags of a table."""
    return W.partitionBy(*entity).orderBy(*order)


def running_sums(entity: Sequence[str], order: Sequence[str], measures: Mapping[str, str | Column]) -> dict[str, Column]:
    """Running sum expressions (missing counts as 0) that share one sort."""
    w = season_window(entity, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return {name: F.sum(zero_if_null(c)).over(w) for name, c in measures.items()}


def running_totals(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], measures: Mapping[str, str | Column]
) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in running_sums(entity, order, measures).items()])


def running_totals_long(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, str],
    block: str | Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The same totals for histories too long for one task.

    Histories are cut by ranges of (entity, order) into pieces of about ``rows_per_task`` rows, wherever the rows lie.
    ``block`` cuts them by a column instead (say, the month of a timestamp); then the longest block bounds a task.
    Pieces are summed independently and the totals of earlier pieces are added.
    """
    if block is None:
        return prefix_sums(df, entity, order, measures, rows_per_task)
    cut = df.withColumn("__block", F.col(block) if isinstance(block, str) else block)
    keys = [*entity, "__block"]
    inner = running_totals(cut, keys, order, measures)
    totals = cut.groupBy(*keys).agg(*[F.sum(zero_if_null(c)).alias(f"__t_{n}") for n, c in measures.items()])
    before = W.partitionBy(*entity).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in measures]
    )
    shifted = {n: F.col(n) + F.col(f"__o_{n}") for n in measures}
    return inner.join(offsets, keys).withColumns(shifted).drop("__block", *[f"__o_{n}" for n in measures])


def running_totals_unpivoted(
    df: DataFrame, entity: Sequence[str], order: str, measures: Sequence[str], prefix: str = "cum_"
) -> DataFrame:
    """Many running totals as one window over (entity, metric), pivoted back to columns."""
    typed = df.select(*entity, order, *[F.col(m).cast("double").alias(m) for m in measures])
    long = typed.unpivot([*entity, order], list(measures), "metric", "value")
    summed = running_totals(long, [*entity, "metric"], [order], {"total": "value"})
    return summed.groupBy(*entity, order).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("total"))).alias(f"{prefix}{m}") for m in measures]
    )


def per_game(totals: Sequence[str], games: str, pattern: str = "{}_per_game") -> dict[str, Column]:
    return {pattern.format(t): safe_ratio(t, games) for t in totals}


def lagged(
    entity: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[str, object]], offset: int = 1
) -> dict[str, Column]:
    """Lag expressions: output name -> (column, default for the first and for missing rows)."""
    w = season_window(entity, order)
    out = {}
    for name, (source, default) in columns.items():
        lag = F.lag(source, offset).over(w)
        out[name] = lag if default is None else F.coalesce(lag, default if isinstance(default, Column) else F.lit(default))
    return out


def attach_group_stats(df: DataFrame, group: Sequence[str], *stats: Column) -> DataFrame:
    """Aggregate per group with map-side combining and join the result to every row."""
    return df.join(df.groupBy(*group).agg(*stats), list(group), "left")


def group_zscores(
    df: DataFrame, group: Sequence[str], columns: Mapping[str, str], ddof: int = 1, digits: int | None = None
) -> DataFrame:
    """(x - mean) / sd within a group; ``ddof=1`` is the sample sd, ``0`` the population sd."""
    spread = F.stddev_samp if ddof == 1 else F.stddev_pop
    stats = []
    for source in columns.values():
        stats += [F.avg(source).alias(f"__m_{source}"), spread(source).alias(f"__s_{source}")]
    out = attach_group_stats(df, group, *stats)
    scores = {}
    for name, source in columns.items():
        z = safe_ratio(F.col(source) - F.col(f"__m_{source}"), f"__s_{source}")
        scores[name] = z if digits is None else F.round(z, digits)
    drop = [f"__{k}_{s}" for s in columns.values() for k in ("m", "s")]
    return out.withColumns(scores).drop(*drop)


def with_global_extremes(df: DataFrame, extremes: Mapping[str, Column]) -> DataFrame:
    """Attach one-row aggregates of the whole table to each row as scalar subqueries."""
    return df.withColumns({n: df.agg(c.alias(n)).scalar() for n, c in extremes.items()})
