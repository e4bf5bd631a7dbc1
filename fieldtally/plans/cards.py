"""Card power over the years: first printings, tolerant numbers, ratio-of-sums trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count, tolerant_number
from ..operators.aggregates import ratio_of_sums
from ..operators.joins import left_attach
from ..operators.ranking import at_group_min

# Sets and patterns that are left out, colours, last reliable year: fixed values
JOKE_SETS = ["Unglued", "Unhinged", "Unstable", "Unfinity", "Unsanctioned"]
TEST_SETS = ["UPLIST", "CMB1", "CMB2"]
KIND_PATTERN = "Creature"
DIGITAL_PATTERN = "^A-"
UNKNOWN_PATTERN = "[*?]"
LAST_YEAR = 2022
COLOURS = {"": "Colorless", "['W']": "White", "['U']": "Blue", "['B']": "Black", "['R']": "Red", "['G']": "Green"}
KEPT_COLUMNS = ["name", "layout", "cmc", "power", "toughness", "release_year", "color_identity", "text"]


def first_printings(cards: DataFrame, set_years: DataFrame) -> DataFrame:
    """Creature cards in their first year, with numeric strength and text length."""
    dated = left_attach(cards, set_years, {"set": "set_name"})
    kept = dated.where(
        F.col("type").rlike(KIND_PATTERN)
        & ~F.col("set").isin(JOKE_SETS + TEST_SETS)
        & ~F.col("name").rlike(DIGITAL_PATTERN)
        & (F.col("layout") == "normal")
    ).select(*KEPT_COLUMNS)
    first = at_group_min(kept, ["name"], "release_year", null_empties_group=True)
    measured = first.withColumn("text_num", F.length("text")).distinct()
    # a missing value does not match the pattern, so its card stays
    unknown = [F.coalesce(F.col(c).rlike(UNKNOWN_PATTERN), F.lit(False)) for c in ("power", "toughness")]
    known = measured.where(~unknown[0] & ~unknown[1])
    numbers = {c: tolerant_number(c) for c in ("power", "toughness")}
    return known.withColumns(numbers).where(F.col("release_year") <= LAST_YEAR)


def with_colour(cards: DataFrame) -> DataFrame:
    """One-colour cards by colour; several colours and none are left out."""
    identity, chain = F.col("color_identity"), F
    for code, name in COLOURS.items():
        chain = chain.when(identity == code, F.lit(name))
    chain = chain.when(char_count(identity, ",").between(1, 4), F.lit("Multi Color"))
    return cards.withColumn("colour", chain).where(~F.col("colour").isin("Colorless", "Multi Color"))


def trends(cards: DataFrame, by: Sequence[str] = ("release_year",)) -> DataFrame:
    return cards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_new_cards"),
        *[F.round(F.avg(c), 6).alias(f"avg_{n}") for c, n in (("power", "power"), ("toughness", "toughness"), ("cmc", "cmc"), ("text_num", "text_len"))],
        ratio_of_sums(["power"], "toughness").alias("power_per_toughness"),
        ratio_of_sums(["power"], "cmc").alias("power_per_cost"),
        ratio_of_sums(["toughness"], "cmc").alias("toughness_per_cost"),
        ratio_of_sums(["power", "toughness"], "cmc").alias("strength_per_cost"),
        ratio_of_sums(["power", "toughness"], "text_num").alias("strength_per_text"),
    )
