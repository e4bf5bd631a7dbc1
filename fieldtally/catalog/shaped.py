"""Pivot, unpivot, signed shares and display order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.nulls import column_total, safe_ratio
from ..operators import columns, reshape
from ..sources.files import table
from .registry import query
from .tables import VOTES_SQL, votes


@query(
    "pivot_signed_margin",
    f"""WITH {VOTES_SQL}, sums AS (
        SELECT place, month, round(sum(votes), 2) AS total, round(sum(CASE WHEN party = 'O' THEN votes END), 2) AS votes_O,
               round(sum(CASE WHEN party = 'F' THEN votes END), 2) AS votes_F FROM votes GROUP BY ALL),
      shares AS (SELECT place, month, votes_O, votes_F, round(votes_O / total, 6) AS share_O, round(votes_F / total, 6) AS share_F FROM sums
                 WHERE votes_O IS NOT NULL OR votes_F IS NOT NULL),
      lead AS (SELECT *, CASE WHEN share_O IS NULL OR share_F IS NULL THEN NULL
                              WHEN share_F >= share_O THEN -share_F ELSE share_O END AS diff FROM shares)
      SELECT *, CASE WHEN diff < 0 THEN round(1 + diff, 6) ELSE diff END AS unit_diff FROM lead""",
)
def pivot_signed_margin(spark, sf):
    v = votes(spark, sf)
    by_party = v.groupBy("place", "month", "party").agg(F.round(F.sum("votes"), 2).alias("votes"))
    totals = v.groupBy("place", "month").agg(F.round(F.sum("votes"), 2).alias("total"))
    shares = by_party.join(totals, ["place", "month"]).withColumn("share", F.round(safe_ratio("votes", "total"), 6))
    wide = reshape.to_wide(shares, ["place", "month"], "party", ["O", "F"], ["votes", "share"], ["votes"])
    lead = wide.withColumn("diff", numeric.signed_lead("share_O", "share_F"))
    return lead.withColumn("unit_diff", F.when(F.col("diff") < 0, F.round(numeric.unit_interval("diff"), 6)).otherwise(F.col("diff")))


SIZES = {"small": (1, 10), "medium": (11, 20), "large": (21, 35), "huge": (36, 50)}
FLAGS = ["A", "N", "R"]
LEVELS = ["small", "medium", "large", "huge"]


@query(
    "wide_fold_unpivot",
    """WITH sized AS (
         SELECT l_returnflag AS flag, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 20 THEN 'medium'
                WHEN p_size <= 35 THEN 'large' ELSE 'huge' END AS size, l_quantity AS q
         FROM lineitem JOIN part ON l_partkey = p_partkey)
       SELECT flag, size || ' items' AS label, CASE WHEN flag = 'A' THEN -sum(q) ELSE sum(q) END AS count,
              CASE size WHEN 'small' THEN 1 WHEN 'medium' THEN 2 WHEN 'large' THEN 3 ELSE 4 END AS sort_key
       FROM sized GROUP BY flag, size""",
)
def wide_fold_unpivot(spark, sf):
    """One wide row of tract-like column groups, folded, unpivoted, one side negated."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    sized = li.join(p, "l_partkey")
    # wide and finer than needed: two halves of each size class, as in age tables
    parts, groups = {}, {}
    for flag in FLAGS:
        for size, (lo, hi) in SIZES.items():
            middle = (lo + hi) // 2
            halves = {f"{flag}_{size}_low": (lo, middle), f"{flag}_{size}_high": (middle + 1, hi)}
            groups[f"{flag}_{size}_items"] = list(halves)
            for name, (a, b) in halves.items():
                parts[name] = F.when((F.col("l_returnflag") == flag) & F.col("p_size").between(a, b), F.col("l_quantity"))
    wide = sized.select(*[c.alias(n) for n, c in parts.items()])
    folded = reshape.fold_groups(wide, groups)
    long = reshape.to_long(folded, [], list(groups), ["flag", "size"], "count")
    signed = long.withColumn("count", F.when(F.col("flag") == "A", -F.col("count")).otherwise(F.col("count")))
    ordered = reshape.display_order(signed, "size", LEVELS)
    labels = columns.recode("size", {s: f"{s} items" for s in LEVELS})
    return ordered.select("flag", labels.alias("label"), "count", "sort_key")


@query(
    "fold_columns",
    """SELECT l_suppkey, count(*) AS total, round_even(count(*) FILTER (WHERE l_returnflag = 'A') / 5, 0) AS dots_a,
              round_even((count(*) FILTER (WHERE l_returnflag = 'N') + count(*) FILTER (WHERE l_returnflag = 'R')) / 5, 0) AS dots_other
       FROM lineitem GROUP BY 1""",
)
def fold_columns(spark, sf):
    flag = F.col("l_returnflag")
    wide = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(flag == f).alias(f) for f in FLAGS]
    )
    return wide.select(
        "l_suppkey", "total", numeric.half_even(F.col("A") / 5).alias("dots_a"),
        numeric.half_even(column_total(["N", "R"]) / 5).alias("dots_other"),
    )
