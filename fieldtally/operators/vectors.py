"""Many measures as one array column with a list of their names.

Hundreds of like-treated columns make plans that take longer to build and compile than to run.  Here a row holds one
``array<double>``; where a measure stands is known when the plan is built, so weighting is one transform, a
match-up is one element-wise product, and all running sums share one grouping and one fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positions(names: Sequence[str], wanted: Sequence[str]) -> list[int]:
    at = {n: i for i, n in enumerate(names)}
    return [at[w] for w in wanted]


def packed(columns: Sequence[str | Column]) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def taken(vector: Column, at: Sequence[int]) -> Column:
    """The elements at fixed places, in that order."""
    if at and list(at) == list(range(at[0], at[0] + len(at))):
        return F.slice(vector, at[0] + 1, len(at))
    return F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.get(vector, i))


def scaled(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def divided(vector: Column, by: Column) -> Column:
    """Missing where the divisor is zero."""
    return F.transform(vector, lambda x: F.try_divide(x, by))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def ratios(vector: Column, pairs: Sequence[tuple[int, int]]) -> Column:
    """One quotient of two elements per pair of places."""
    return F.zip_with(taken(vector, [a for a, _ in pairs]), taken(vector, [b for _, b in pairs]), F.try_divide)


def filled(vector: Column, at: Sequence[int], value: float = 0.0) -> Column:
    """Missing elements at some places become ``value``."""
    here = F.array(*[F.lit(i) for i in at])
    return F.transform(vector, lambda x, i: F.when(F.array_contains(here, i), F.coalesce(x, F.lit(value))).otherwise(x))


def running_vectors(df: DataFrame, entity: Sequence[str], order: str, sums: Mapping[str, str]) -> DataFrame:
    """Adds running sums (missing elements count as 0) of array columns: output name -> array column.

    The rows of an entity are folded in one array, so they must be few: one row a period.  All vectors share one shuffle.
    """
    others = [c for c in df.columns if c not in (*entity, order)]
    rows = df.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("__rows"))
    # array_sort compares the fields in turn: the period, unique within an entity, decides

    def whole(row: Column) -> Column:
        vectors = [F.transform(row[c], lambda x: F.coalesce(x, F.lit(0.0))) for c in sums.values()]
        return F.concat(*vectors) if len(vectors) > 1 else vectors[0]

    start = F.struct(F.array().cast("array<array<double>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        return F.when(F.size(acc["out"]) == 0, whole(row)).otherwise(F.zip_with(F.element_at(acc["out"], -1), whole(row), lambda a, b: a + b))

    folded = F.aggregate("__rows", start, lambda acc, row: F.struct(F.array_append(acc["out"], step(acc, row)).alias("out")), lambda acc: acc["out"])
    paired = rows.select(*entity, F.explode(F.arrays_zip(F.col("__rows").alias("row"), folded.alias("sums"))).alias("p"))
    flat = paired.select(*entity, F.col("p.row.*"), F.col("p.sums").alias("__sums"))
    return cut(flat, sums)


def cut(df: DataFrame, sums: Mapping[str, str]) -> DataFrame:
    """``__sums``, the vectors one after the other, back into one column each."""
    start, out = F.lit(1), {}
    for name, source in sums.items():
        out[name] = F.slice("__sums", start, F.size(source))
        start = start + F.size(source)
    return df.withColumns(out).drop("__sums")


@dataclass
class Vectors:
    """A table with array columns, and the names of their elements."""

    frame: DataFrame
    names: dict[str, list[str]]

    def element(self, name: str) -> Column:
        for vector, names in self.names.items():
            if name in names:
                return F.get(F.col(vector), F.lit(names.index(name))).alias(name)
        return F.col(name)

    def wide(self, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
        """Chosen (or all) measures as columns."""
        wanted = [n for names in self.names.values() for n in names] if columns is None else columns
        return self.frame.select(*keys, *[self.element(n) for n in wanted])

    def long(self, keys: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
        """One row per measure."""
        pairs = F.concat(*[
            F.zip_with(F.array(*map(F.lit, names)), F.col(vector), lambda n, v: F.struct(n.alias(name), v.alias(value))) for vector, names in self.names.items()
        ])
        return self.frame.select(*keys, F.inline(pairs))
