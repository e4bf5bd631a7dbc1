"""Weekly league scores: from running totals to weekly scores, standardised per week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import group_zscores, lagged


def standard_scores(points: DataFrame, digits: int | None = None) -> DataFrame:
    columns = {"std_points_for": "Points_For", "std_points_against": "Points_Against"}
    return group_zscores(points, ["Week"], columns, ddof=1, digits=digits)


def weekly_scores(points: DataFrame) -> DataFrame:
    """The points tables are season totals so far; a week's score is the step between weeks."""
    before = lagged(["Person"], ["Week"], {f"__{c}": (c, 0.0) for c in ("Points_For", "Points_Against")})
    stepped = points.withColumns(before)
    return stepped.withColumns({c: F.col(c) - F.col(f"__{c}") for c in ("Points_For", "Points_Against")}).drop(*before)
