"""Grouped measures.

Each helper returns aggregate columns, so a caller puts as many as needed into one
``groupBy().agg()`` and the input is shuffled once after map-side combining.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import as_col, safe_ratio
from ..session import store


def sum_where(condition: Column, value: str | Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, as_col(value))), F.lit(0))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def threshold_family(
    value: str, thresholds: Sequence[float], classes: Mapping[str, Column], pattern: str
) -> list[Column]:
    """One count per class and threshold; ``pattern`` has {cls} and {t}."""
    return [
        F.count_if(cond & (F.col(value) >= t)).alias(pattern.format(cls=cls, t=t))
        for t in thresholds
        for cls, cond in classes.items()
    ]


def stage_counts(stage: str, stages: Mapping[int, str], success: Column, base: Column) -> list[Column]:
    """Attempts and conversions per stage."""
    cols = []
    for value, name in stages.items():
        tried = base & (F.col(stage) == value)
        cols.append(F.count_if(tried).alias(f"{name}_attempts"))
        cols.append(F.count_if(tried & success).alias(f"{name}_converted"))
    return cols


def stage_rates(stages: Mapping[int, str], digits: int = 6) -> list[Column]:
    return [
        F.round(safe_ratio(f"{n}_converted", f"{n}_attempts"), digits).alias(f"{n}_efficiency")
        for n in stages.values()
    ]


def distinct_where(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    conditions: Mapping[str, Column],
    count_null: bool | Sequence[str] = False,
) -> DataFrame:
    """Distinct items per group under several conditions.

    The rows collapse to one flag row per (group, item) first, so a hot group is spread over
    its items and several conditions cost no row multiplication.  With ``count_null`` (for
    all or for the named conditions) a missing condition, or a true one on a missing item,
    counts as one more value.
    """
    null_names = set(conditions) if count_null is True else set(count_null or ())
    flags = []
    for name, cond in conditions.items():
        flags.append(F.max(F.when(cond, 1).otherwise(0)).alias(name))
        flags.append(F.max(F.when(cond.isNull(), 1).otherwise(0)).alias(f"__null_{name}"))
    per_item = df.groupBy(*group, item).agg(*flags)
    out = []
    for name in conditions:
        known = F.sum(F.when(F.col(item).isNotNull(), F.col(name)).otherwise(0))
        if name in null_names:
            missing = F.max(
                F.greatest(F.col(f"__null_{name}"), F.when(F.col(item).isNull(), F.col(name)).otherwise(0))
            )
            known = known + missing
        out.append(known.cast("long").alias(name))
    return per_item.groupBy(*group).agg(*out)


def distinct_per_group(df: DataFrame, group: Sequence[str], item: str, name: str) -> DataFrame:
    """Exact distinct count in two combining steps: (group, item), then group."""
    return df.select(*group, item).distinct().groupBy(*group).agg(F.count(item).alias(name))


def value_at_last(value: str | Column, order: Sequence[str]) -> Column:
    return F.max_by(as_col(value), F.struct(*order))


def value_at_first(value: str | Column, order: Sequence[str]) -> Column:
    return F.min_by(as_col(value), F.struct(*order))


def text_max_where(condition: Column, value: str) -> Column:
    return F.max(F.when(condition, F.col(value)))


def ratio_of_sums(numerators: Sequence[str], denominator: str, digits: int = 6) -> Column:
    total = sum((F.coalesce(F.sum(n), F.lit(0.0)) for n in numerators[1:]), F.coalesce(F.sum(numerators[0]), F.lit(0.0)))
    return F.round(safe_ratio(total, F.sum(denominator)), digits)


def minutes_where(condition: Column, minutes: str, seconds: str) -> Column:
    """Minutes and seconds parts as minutes; missing if a flagged part is missing."""
    whole = F.when(condition, F.col(minutes) * 60 + F.col(seconds))
    complete = F.count_if(condition) == F.count(whole)
    return F.when(complete, F.coalesce(F.sum(whole), F.lit(0)) / 60)


def total_or_parts(
    df: DataFrame,
    unit: Sequence[str],
    group: Sequence[str],
    is_total: Column,
    sums: Sequence[str],
    means: Sequence[str],
) -> DataFrame:
    """Use reported total rows where a unit has any, else add up the parts.

    Sums and means of the parts stay aligned with the total rows' columns.

    One scan and one aggregate: total rows are grouped by their own values (and counted, so equal ones stay), parts by
    ``group``, both under their unit.  Whether a unit has total rows is then asked among these few rows.
    """
    values = [*sums, *means]
    keys = list(dict.fromkeys([*unit, *group]))
    flag = F.coalesce(is_total, F.lit(False))
    flagged = df.where(is_total.isNotNull()).withColumn("__total", flag)
    own = [F.when(F.col("__total"), F.col(c)).alias(f"__own_{c}") for c in values]
    cells = flagged.groupBy(*keys, "__total", *own).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(f"__sum_{c}") for c in values], *[F.count(c).alias(f"__n_{c}") for c in means]
    )
    units = W.partitionBy(*[F.col(c) for c in unit])
    # a missing unit matches no other, so its parts are always added up
    known = ~F.coalesce(*[F.when(F.col(c).isNull(), F.lit(True)) for c in unit], F.lit(False))
    marked = cells.withColumn("__has", known & F.max("__total").over(units)).where(F.col("__total") | ~F.col("__has"))
    # a total row stays itself, as often as it was there; parts of a group meet in one row
    copies = F.when(F.col("__total"), F.sequence(F.lit(1).cast("long"), F.col("__rows"))).otherwise(F.array(F.lit(0).cast("long")))
    itself = [F.when(F.col("__total"), F.col(c)).alias(f"__unit_{c}") for c in unit if c not in group]
    sums_of = {c: F.sum(f"__sum_{c}") for c in sums} | {c: F.try_divide(F.sum(f"__sum_{c}"), F.sum(f"__n_{c}")) for c in means}
    rows = marked.withColumn("__copy", F.explode(copies)).groupBy(*group, "__total", "__copy", *[f"__own_{c}" for c in values], *itself)
    out = rows.agg(*[c.alias(f"__of_{n}") for n, c in sums_of.items()])
    return out.select(*group, *[F.when(F.col("__total"), F.col(f"__own_{c}")).otherwise(F.col(f"__of_{c}")).alias(c) for c in values])


def two_sided(
    facts: DataFrame, side: str, other: str, period: Sequence[str], parts: Mapping[str, Column], own: Mapping[str, Column], faced: Mapping[str, Column], label: str = "pairs"
) -> DataFrame:
    """One row per ``side`` and period from a single pass over ``facts``: what it did itself, and what was done to it.

    The facts are aggregated once to (side, other, period) by ``parts`` and stored; this narrow table is rolled up to
    both sides: ``own`` over the rows where a unit is ``side``, ``faced`` where it is ``other``.
    """
    pairs = store(facts.groupBy(side, other, *period).agg(*[c.alias(n) for n, c in parts.items()]), label)
    did = pairs.groupBy(side, *period).agg(*[c.alias(n) for n, c in own.items()])
    met = pairs.withColumn("__side", F.col(other)).groupBy("__side", *period).agg(*[c.alias(n) for n, c in faced.items()])
    return did.join(met.withColumnRenamed("__side", side), [side, *period], "left")
