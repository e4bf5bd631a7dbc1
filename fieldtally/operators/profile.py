"""Summaries of whole columns: moments, correlations, medians, modes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .prefix import prefix_sums


def describe(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """count, mean, sd, min, max per column from one aggregation."""
    stats = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("n"),
                F.round(F.avg(c), digits).alias("mean"),
                F.round(F.stddev_samp(c), digits).alias("sd"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            )
            for c in columns
        ]
    )
    return df.agg(stats.alias("s")).select(F.inline("s"))


def correlations(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pairwise correlations in long form, one scan, only (columns)^2 / 2 running sums."""
    pairs = list(combinations_with_replacement(columns, 2))
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(F.corr(a, b), digits).alias("r"))
            for a, b in pairs
        ]
    )
    return df.agg(cells.alias("s")).select(F.inline("s"))


def correlations_with(df: DataFrame, target: str, columns: Sequence[str], digits: int = 6) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.round(F.corr(c, target), digits).alias("r")) for c in columns]
    )
    return df.agg(cells.alias("s")).select(F.inline("s"))


def exact_medians(df: DataFrame, columns: Sequence[str], small: int = 1_000_000) -> dict[str, float | None]:
    """Exact medians without gathering a column in one task.

    Each pass is one aggregate row for all columns: it counts the rows under the current
    bracket and asks for approximate quantiles just around the middle, which narrows the
    bracket some thousandfold.  Once a bracket holds few rows, its values are counted and
    read off exactly.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    brackets: dict[str, tuple[float | None, float | None]] = {c: (None, None) for c in columns}
    below = {c: 0 for c in columns}
    total: dict[str, int] = {}
    width: dict[str, int] = {}

    def inside(c):
        lo, hi = brackets[c]
        cond = F.col(c).isNotNull()
        return cond if lo is None else cond & (F.col(c) >= lo) & (F.col(c) <= hi)

    missed = False
    row = data.agg(*[F.count(c).alias(c) for c in columns]).first()
    for c in columns:
        total[c] = width[c] = row[c]
    while True:
        wide = [c for c in columns if width[c] > small and (brackets[c][0] is None or brackets[c][0] != brackets[c][1])]
        if not wide:
            break
        asks = []
        for c in wide:
            # the bracket must hold both middle positions, so it reaches just past each
            lower, upper = (total[c] - 1) // 2 - below[c], total[c] // 2 - below[c]
            probs = [max(0.0, lower / width[c] - 3e-4), min(1.0, (upper + 1) / width[c] + 3e-4)]
            asks.append(F.percentile_approx(F.when(inside(c), F.col(c)), probs, 10000).alias(c))
        got = data.agg(*asks).first()
        before = {c: (brackets[c], below[c]) for c in wide}
        for c in wide:
            brackets[c] = tuple(got[c])
        row = data.agg(
            *[F.count_if(F.col(c) < brackets[c][0]).alias(f"b{i}") for i, c in enumerate(wide)],
            *[F.count_if(inside(c)).alias(f"w{i}") for i, c in enumerate(wide)],
        ).first()
        for i, c in enumerate(wide):
            under, held = row[f"b{i}"], row[f"w{i}"]
            if under > (total[c] - 1) // 2 or under + held <= total[c] // 2:
                # the approximation missed a middle position: read the wider bracket instead
                (brackets[c], below[c]), width[c] = before[c], 0
                missed = True
            else:
                # no progress means a handful of heavily repeated values is left
                below[c], width[c] = under, 0 if held == width[c] else held
    pieces = F.array(
        *[F.struct(F.lit(c).alias("c"), F.when(inside(c), F.col(c)).alias("v")) for c in columns]
    )
    counted = data.select(F.inline(pieces)).where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    start = F.lit(0).cast("long")
    last = F.lit(0).cast("long")
    for c in columns:
        start = F.when(F.col("c") == c, F.lit(below[c])).otherwise(start)
        last = F.when(F.col("c") == c, F.lit(total[c] - 1)).otherwise(last)
    # where a bracket could not be narrowed, its distinct values may be many: they are summed up range by range
    if missed:
        counted = store(counted, "median-counts")
    upto = prefix_sums(counted, ["c"], ["v"], {"upto": "n"}, rows_per_task=small, parts=None if missed else 1)
    placed = upto.select(
        "c", "v", (start + F.col("upto") - F.col("n")).alias("first"), (start + F.col("upto") - 1).alias("final"),
        F.floor(last / 2).alias("lo"), F.ceil(last / 2).alias("hi"),
    )
    hit = placed.where(
        F.col("lo").between(F.col("first"), F.col("final")) | F.col("hi").between(F.col("first"), F.col("final"))
    )
    found = {r["c"]: r["m"] for r in hit.groupBy("c").agg(((F.min("v") + F.max("v")) / 2).alias("m")).collect()}
    return {c: found.get(c) for c in columns}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per text column; ties go to the alphabetically first."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s")).select("s.*")
    counts = long.where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    found = {r["c"]: r["v"] for r in best.collect()}
    return {c: found.get(c) for c in columns}
