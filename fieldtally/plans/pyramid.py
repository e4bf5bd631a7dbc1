"""Population pyramid: fine age columns folded to five-year groups, one side negated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import recode
from ..operators.reshape import display_order, fold_groups, to_long

# Sexes, and the age columns of the source under their five-year group: fixed values
SEXES = ["Male", "Female"]
AGE_GROUPS = {
    "Under 5": ["Under_5"], "5 to 9": ["5_to_9"], "10 to 14": ["10_to_14"], "15 to 19": ["15_to_17", "18_to_19"],
    "20 to 24": ["20", "21", "22_to_24"], "25 to 29": ["25_to_29"], "30 to 34": ["30_to_34"], "35 to 39": ["35_to_39"],
    "40 to 44": ["40_to_44"], "45 to 49": ["45_to_49"], "50 to 54": ["50_to_54"], "55 to 59": ["55_to_59"],
    "60 to 64": ["60_to_61", "62_to_64"], "65 to 69": ["65_to_66", "67_to_69"], "70 to 74": ["70_to_74"],
    "75 to 79": ["75_to_79"], "80 to 84": ["80_to_84"], "85 and Up": ["85_and_Up"],
}


def age_columns(suffix: str = "E") -> list[str]:
    return [f"{sex}_{age}{suffix}" for sex in SEXES for ages in AGE_GROUPS.values() for age in ages]


def pyramid(wide: DataFrame, groups: Mapping[str, Sequence[str]] = AGE_GROUPS, negate: str = "Male", suffix: str = "E") -> DataFrame:
    """Gender, age group, signed count and display position over all rows of the table."""
    folds = {
        f"{sex}_{label.replace(' ', '_')}": [f"{sex}_{age}{suffix}" for age in ages] for sex in SEXES for label, ages in groups.items()
    }
    long = to_long(fold_groups(wide, folds), [], list(folds), ["Gender", "Age_Group"], "Count")
    # the split keeps the first word of a label only
    words = {label.split(" ")[0]: label for label in groups}
    named = long.withColumns(
        {
            "Age_Group": recode("Age_Group", words),
            "Count": F.when(F.col("Gender") == negate, -F.col("Count")).otherwise(F.col("Count")),
        }
    )
    return display_order(named, "Age_Group", list(groups))
