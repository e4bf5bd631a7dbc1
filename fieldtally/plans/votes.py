"""County vote shares: reconciled totals, signed margin, map classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_ratio
from ..functions.numeric import half_even, interval_bin, signed_lead, unit_interval
from ..functions.text import part, remove_first
from ..operators.aggregates import total_or_parts
from ..operators.joins import inner_match
from ..operators.reshape import to_wide

# Parties, map breaks, states off the map and place names that differ between sources: fixed values
PARTIES = ["DEMOCRAT", "REPUBLICAN"]
BREAKS = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 1.0]
OFF_MAP = ["ALASKA", "HAWAII"]
PLACE_WORDS = ["COUNTY", "PARISH"]
COUNTY_NAMES = {"ST MARY'S": "ST. MARY'S", "SAINT LOUIS": "ST. LOUIS", "ST. LOUIS COUNTY": "ST. LOUIS"}
COUNTY_NAMES_BY_STATE = {("LOUISIANA", "LA SALLE"): "LASALLE"}


def map_labels(breaks=BREAKS, left: str = "Republican", right: str = "Democrat") -> list[str]:
    """Names of the classes, computed from the breaks so that none is skipped."""
    def pct(x):
        return f"{round(100 * x)}%"

    labels = []
    for a, b in zip(breaks, breaks[1:]):
        if b == breaks[1]:
            labels.append(f"{pct(1 - b)}+ {left}")
        elif a == breaks[-2]:
            labels.append(f"{pct(a)}+ {right}")
        elif a < 0.5 < b:
            labels.append(f"{pct(1 - a)} {left} to {pct(b)} {right}")
        elif b <= 0.5:
            labels.append(f"{pct(1 - b)} to {pct(1 - a)} {left}")
        else:
            labels.append(f"{pct(a)} to {pct(b)} {right}")
    return labels


def split_place(df: DataFrame, name: str = "NAME") -> DataFrame:
    """ "X County, State" to matching keys."""
    county: Column = part(name, ",", 0)
    for word in PLACE_WORDS:
        county = remove_first(county, word)
    return df.withColumns({"state": part(name, ",", 1), "county_name": county})


def candidate_totals(returns: DataFrame, year: int) -> DataFrame:
    """Reported total rows where a state has them, the sum of the parts elsewhere."""
    rows = returns.where((F.col("year") == year) & F.col("party").isin(PARTIES))
    return total_or_parts(
        rows, unit=["state"], group=["state", "county_name", "party"], is_total=F.col("mode") == "TOTAL",
        sums=["candidatevotes"], means=["totalvotes"],
    )


def county_margins(returns: DataFrame, year: int) -> DataFrame:
    """One row per county: both shares and the leader's share, negative for one side."""
    totals = candidate_totals(returns, year).withColumn("share", half_even(safe_ratio("candidatevotes", "totalvotes"), 3))
    wide = to_wide(totals, ["state", "county_name"], "party", PARTIES, ["share", "totalvotes"], ["candidatevotes", "totalvotes"])
    named = wide.select(
        "state", "county_name", F.col("share_DEMOCRAT").alias("Democrat"), F.col("share_REPUBLICAN").alias("Republican"),
        F.col("totalvotes_DEMOCRAT").alias("TotalVotes"),
    )
    return named.where(~F.col("state").isin(OFF_MAP)).withColumn("diff", signed_lead("Democrat", "Republican"))


def matched_names(margins: DataFrame) -> DataFrame:
    """County names as the shapes spell them."""
    name, chain = F.col("county_name"), F
    for (state, old), new in COUNTY_NAMES_BY_STATE.items():
        chain = chain.when((F.col("state") == state) & (name == old), F.lit(new))
    for old, new in COUNTY_NAMES.items():
        chain = chain.when(name == old, F.lit(new))
    return margins.withColumn("county_name", chain.otherwise(name))


def vote_map(returns: DataFrame, counties: DataFrame, year: int) -> DataFrame:
    """Margins on the county table, mapped to 0..1 and put into map classes."""
    joined = inner_match(counties, matched_names(county_margins(returns, year)), ["state", "county_name"])
    unit = joined.withColumn("diff", unit_interval("diff"))
    return unit.withColumn("map_class", interval_bin("diff", BREAKS, map_labels()))
