"""Choosing, renaming, recoding and aligning columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import as_col, blank_to_null


def rename_codes(df: DataFrame, names: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Select coded columns under readable names, in the order of ``names``."""
    return df.select(*keep, *[F.col(code).alias(name) for code, name in names.items()])


def codes_to_wide(
    df: DataFrame, key: str, code: str, value: str, names: Mapping[str, str]
) -> DataFrame:
    """Long (key, code, value) rows to one row per key with a named column per code.

    Listing the codes keeps the pivot a single aggregation.
    """
    sums = [F.sum(F.when(F.col(code) == c, F.col(value))).alias(n) for c, n in names.items()]
    return df.groupBy(key).agg(*sums)


def recode(c: str | Column, mapping: Mapping, default: str | Column | None = None) -> Column:
    """Replace listed values; others keep their value unless ``default`` is given."""
    c = as_col(c)
    chain = F
    for old, new in mapping.items():
        chain = chain.when(c == F.lit(old), F.lit(new))
    if default is None:
        return chain.otherwise(c)
    return chain.otherwise(as_col(default))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def prefixed_columns(df: DataFrame, *prefixes: str) -> list[str]:
    lowered = tuple(p.lower() for p in prefixes)
    return [c for c in df.columns if c.lower().startswith(lowered)]


def clean_names(df: DataFrame) -> DataFrame:
    """Lower snake case; repeated names get a running number."""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
        base = re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower() or "x"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*out)


def blanks_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: blank_to_null(c) for c in text_columns(df)})


def fill_constants(df: DataFrame, numbers=0, text: str | None = None) -> DataFrame:
    """Missing numbers to a constant and, when asked, missing text to a category."""
    out = df.fillna(numbers, subset=numeric_columns(df))
    return out if text is None else out.fillna(text, subset=text_columns(df))


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    right_names = set(right.columns)
    return [c for c in left.columns if c in right_names]


def extra_columns(left: DataFrame, right: DataFrame) -> list[str]:
    right_names = set(right.columns)
    return [c for c in left.columns if c not in right_names]


def align_to(df: DataFrame, like: DataFrame, fill=0) -> DataFrame:
    """Give ``df`` the columns of ``like`` in that order: extras go, missing ones are ``fill``."""
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(fill).cast(f.dataType).alias(f.name)
            for f in like.schema
        ]
    )
