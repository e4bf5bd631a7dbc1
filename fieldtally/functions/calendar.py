"""Calendar parts.  Weeks are seven-day blocks counted from 1 January, not ISO weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col


def block_week(c: str | Column) -> Column:
    return (F.floor((F.dayofyear(as_col(c)) - 1) / 7) + 1).cast("int")


def month_start(c: str | Column) -> Column:
    return F.trunc(as_col(c), "month")


def calendar_parts(c: str | Column) -> dict[str, Column]:
    c = as_col(c)
    return {
        "year": F.year(c),
        "month": F.month(c),
        "week": block_week(c),
        "day": F.dayofyear(c),
        "month_year": month_start(c),
    }


def up_to_last_year(c: str | Column, reference_date: str | Column) -> Column:
    """Keep whole years before the year of the reference date."""
    ref = F.lit(reference_date).cast("date") if isinstance(reference_date, str) else reference_date
    return F.year(as_col(c)) <= F.year(ref) - 1


def parse_utc(c: str | Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """ISO text in UTC to a zone-free timestamp."""
    return F.to_timestamp_ntz(as_col(c), F.lit(pattern))
