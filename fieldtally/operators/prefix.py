"""Running sums over orders of any length: ranges of the order key, totals per range, offsets added.

Rows are dealt by ranges of (group, order), so a group may lie in many tasks and no task holds more than about
``rows_per_task`` rows, whether one group has all rows or all rows have one key.  Each range is summed alone; the
totals of earlier ranges, one row per group and task, are added to it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import as_col, zero_if_null
from ..session import store

ROWS_PER_TASK = 1_000_000


def in_ranges(df: DataFrame, order: Sequence[str | Column], parts: int, label: str = "ranges") -> DataFrame:
    """Stored rows with ``__part`` (the range) and ``__id`` (ascending in order, over all ranges).

    Rows with equal keys are told apart by where they were read, so they too are spread over ranges.
    """
    keys = [as_col(c) for c in order]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, *keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    # a row's number is its partition and its place there; the table is written, so neither changes
    return store(dealt.withColumn("__id", F.monotonically_increasing_id()), label).withColumn("__part", F.shiftright("__id", 33))


def prefix_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], measures: Mapping[str, str | Column],
    rows_per_task: int = ROWS_PER_TASK, parts: int | None = None,
) -> DataFrame:
    """``df`` with running sums (missing counts as 0) inside each group, up to and with each row.

    ``df`` is counted and sampled before it is dealt: store it first if it is costly.  What fits one task is summed
    in one window per group.
    """
    if parts is None:
        parts = max(1, -(-df.count() // rows_per_task))
    values = {n: zero_if_null(c) for n, c in measures.items()}
    if parts == 1:
        so_far = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select("*", *[F.sum(v).over(so_far).alias(n) for n, v in values.items()])
    placed = in_ranges(df, [*group, *order], parts)
    keys = [*group, "__part"]
    so_far = W.partitionBy(*keys).orderBy("__id").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = placed.select("*", *[F.sum(v).over(so_far).alias(n) for n, v in values.items()])
    totals = placed.groupBy(*keys).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in group], F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in values]
    )
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    shifted = {n: F.col(n) + F.col(f"__o_{n}") for n in values}
    return inner.join(offsets, same).withColumns(shifted).select(*df.columns, *values)
