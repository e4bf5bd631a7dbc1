"""The rank comparison report: two rankings, their difference, and its colour."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import average_ranks
from ..session import store

# column titles of the printed report: fixed values
REPORT_TITLES = {
    "predicted_rank": "Predicted Rank",
    "actual_rank": "Actual Rank",
    "rank_difference": "Rank Difference",
}


def compare_ranks(df: DataFrame, ids: Sequence[str], predicted: str, actual: str, cut: int = 25) -> DataFrame:
    """Average-tie ranks of two columns, kept where the first is within ``cut``.

    Ranking reads its input several times, so the input and the first ranking are stored.
    """
    scores = store(df.select(*ids, predicted, actual), "scores")
    first = store(average_ranks(scores, predicted, "predicted_rank").select(*ids, actual, "predicted_rank"), "ranked")
    ranked = average_ranks(first, actual, "actual_rank")
    gap = F.col("actual_rank") - F.col("predicted_rank")
    return (
        ranked.where(F.col("predicted_rank") <= cut)
        .select(
            *ids, "predicted_rank", "actual_rank", gap.alias("rank_difference"),
            F.when(gap < 0, "red").when(gap > 0, "green").alias("colour"),
        )
    )


def styled(df: DataFrame, team: str, titles: Mapping[str, str] = REPORT_TITLES) -> DataFrame:
    """Printable table: report titles, ranks without decimals, best first."""
    cells = [F.format_string("%.0f", F.bround(c)).alias(t) for c, t in titles.items()]
    return df.orderBy("predicted_rank", team).select(F.col(team).alias("Team"), *cells, "colour")
