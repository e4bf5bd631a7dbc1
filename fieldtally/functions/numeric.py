"""Numeric expressions: rounding, logs, shares, unit chains and class intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col, strict_greatest


def half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


def floored_log(c: str | Column, floor: float = 0.1) -> Column:
    """Natural log after lifting exact zeros to ``floor``."""
    c = as_col(c)
    return F.ln(F.when(c == 0, F.lit(floor)).otherwise(c))


def duration_chain(seconds: str | Column) -> dict[str, Column]:
    """Seconds as minutes, hours and days, each made from the one before."""
    minutes = as_col(seconds) / F.lit(60.0)
    hours = minutes / F.lit(60.0)
    return {"minutes": minutes, "hours": hours, "days": hours / F.lit(24.0)}


def signed_lead(first: str | Column, second: str | Column) -> Column:
    """The larger share, negative when the second side holds it (missing if either is)."""
    top = strict_greatest(first, second)
    return F.when(top == as_col(second), -top).otherwise(top)


def unit_interval(signed: str | Column) -> Column:
    """A signed share mapped to 0..1: the negative side sits below one half."""
    s = as_col(signed)
    return F.when(s < 0, 1 + s).otherwise(s)


def interval_labels(breaks: list[float]) -> list[str]:
    return [f"{a:g} to {b:g}" for a, b in zip(breaks, breaks[1:])]


def interval_bin(c: str | Column, breaks: list[float], labels: list[str] | None = None) -> Column:
    """Class intervals closed on the left; the last one is closed on both sides.

    Values outside the breaks are missing.
    """
    labels = labels or interval_labels(breaks)
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per interval")
    c = as_col(c)
    chain = F
    for i, label in enumerate(labels):
        last = i == len(labels) - 1
        inside = (c >= breaks[i]) & ((c <= breaks[i + 1]) if last else (c < breaks[i + 1]))
        chain = chain.when(inside, F.lit(label))
    return chain


def class_codes(c: str | Column, edges: list[float]) -> Column:
    """How many edges the value has reached (0 .. len(edges))."""
    c = as_col(c)
    return sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:]), F.when(c >= edges[0], 1).otherwise(0))
