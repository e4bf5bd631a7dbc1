"""Dot density map of population groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import column_total
from ..functions.numeric import half_even
from ..operators.columns import codes_to_wide
from ..operators.spatial import dot_density

# Census variable codes and the groups drawn: fixed values
CENSUS_CODES = {
    "P1_001N": "Tot_Pop", "P2_005N": "Tot_White", "P2_006N": "Tot_Black", "P2_008N": "Tot_Asian", "P2_002N": "Tot_HispLat",
    "P2_007N": "Tot_AmInd", "P2_009N": "Tot_NaHaw", "P2_011N": "Tot_Two", "P2_010N": "Tot_Other",
}
FOLDED = ["Tot_AmInd", "Tot_NaHaw", "Tot_Two", "Tot_Other"]
DRAWN = ["Tot_White", "Tot_Black", "Tot_Asian", "Tot_HispLat", "Total_Other"]
PEOPLE_PER_DOT = 5


def group_counts(long: DataFrame, geo: str = "GEOID") -> DataFrame:
    """Coded long census rows to one wide row per area, small groups folded."""
    wide = codes_to_wide(long, geo, "variable", "value", CENSUS_CODES)
    return wide.withColumn("Total_Other", column_total(FOLDED))


def population_dots(
    areas: DataFrame, geo: str = "GEOID", ring: str = "ring", groups: Sequence[str] = DRAWN, per_dot: int = PEOPLE_PER_DOT, seed: int = 0,
    left_out: Sequence[str] = (),
) -> DataFrame:
    """One random point in its area for every ``per_dot`` people of a group."""
    kept = areas.where(~F.col(geo).isin(list(left_out))) if left_out else areas
    counts: Mapping[str, object] = {g: half_even(F.col(g) / per_dot).cast("long") for g in groups}
    long = kept.withColumns(counts).unpivot([geo, ring], list(groups), "population_group", "dots")
    return dot_density(long, [geo, "population_group"], ring, "dots", seed)
