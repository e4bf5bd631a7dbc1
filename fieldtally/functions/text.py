"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col


def part(c: str | Column, delimiter: str, index: int) -> Column:
    """The index-th piece (from 0) of a delimited text, upper-cased and trimmed."""
    return F.trim(F.upper(F.get(F.split(as_col(c), re.escape(delimiter)), F.lit(index))))


def remove_first(c: str | Column, word: str) -> Column:
    """Drop the first occurrence of a word only, then trim."""
    return F.trim(F.regexp_replace(as_col(c), f"(?s)^(.*?){re.escape(word)}", "$1"))


def alnum_only(c: str | Column, fill: str = "_") -> Column:
    return F.regexp_replace(as_col(c), "[^a-zA-Z0-9]", fill)


def char_count(c: str | Column, char: str) -> Column:
    return F.regexp_count(as_col(c), F.lit(re.escape(char))).cast("int")


def tolerant_number(c: str | Column) -> Column:
    """Text to double; anything that is not a number becomes missing."""
    return as_col(c).try_cast("double")


def joined_label(a: str | Column, b: str | Column, sep: str = ", ") -> Column:
    """Two texts in one label; a missing side shows as NA."""
    return F.concat(F.coalesce(as_col(a), F.lit("NA")), F.lit(sep), F.coalesce(as_col(b), F.lit("NA")))


def fixed_decimals(c: str | Column, digits: int) -> Column:
    """Text with a fixed number of decimals, halves rounded to even."""
    return F.format_string(f"%.{digits}f", F.bround(as_col(c).cast("double"), digits))
