"""Grouped measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.nulls import safe_ratio
from ..functions.numeric import duration_chain
from ..operators import aggregates, profile, windows
from ..sources.files import table
from .registry import query
from .tables import BLOCK_WEEK_SQL, LISTENS_SQL, PLAY_KEY_SQL, PLAY_ORDER, PLAYS_SQL, CARDS_SQL, cards, listens, plays

MONTH = ["team", "year", "week"]


@query(
    "group_basic",
    f"""WITH {LISTENS_SQL}, sums AS (
        SELECT CAST(year(ts) AS INTEGER) AS year, {BLOCK_WEEK_SQL.format(c='ts')} AS week, type,
               round(sum(seconds), 6) AS seconds, round(avg(seconds), 6) AS mean_seconds, count(*) AS plays FROM listens GROUP BY ALL)
      SELECT *, seconds / 60 AS minutes, seconds / 60 / 60 AS hours, seconds / 60 / 60 / 24 AS days FROM sums""",
)
def group_basic(spark, sf):
    sums = listens(spark, sf).groupBy(F.year("ts").alias("year"), calendar.block_week("ts").alias("week"), "type").agg(
        F.round(F.sum("seconds"), 6).alias("seconds"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.count(F.lit(1)).alias("plays")
    )
    return sums.withColumns(duration_chain("seconds"))


@query(
    "latest_period",
    """WITH last AS (SELECT max(CAST(year(o_orderdate) AS INTEGER)) AS y FROM orders),
       lastm AS (SELECT max(CAST(month(o_orderdate) AS INTEGER)) AS m FROM orders, last WHERE year(o_orderdate) = y)
       SELECT o_orderkey, y AS last_year, CAST(m + 1 AS INTEGER) AS next_month, top AS max_price,
              year(o_orderdate) = y AND month(o_orderdate) = m AS in_last_month
       FROM orders, last, lastm, (SELECT max(o_totalprice) AS top FROM orders)""",
)
def latest_period(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")
    )
    last = windows.with_global_extremes(o, {"last": F.max(F.struct("y", "m")), "max_price": F.max("o_totalprice")})
    return last.select(
        "o_orderkey", F.col("last.y").alias("last_year"), (F.col("last.m") + 1).alias("next_month"), "max_price",
        ((F.col("y") == F.col("last.y")) & (F.col("m") == F.col("last.m"))).alias("in_last_month"),
    )


@query(
    "conditional_aggs",
    f"""WITH {PLAYS_SQL}
      SELECT team, year, week, round(coalesce(sum(CASE WHEN kind = 'A' THEN points END), 0), 2) AS pass_points,
             round(coalesce(sum(CASE WHEN kind = 'R' AND discount > 0.08 THEN points END), 0), 2) AS rush_points,
             count(*) FILTER (WHERE kind IN ('A', 'R')) AS scrimmage, count(*) FILTER (WHERE kind = 'N' AND yards >= 40) AS long_kicks,
             CASE WHEN count(*) FILTER (WHERE stage = 1) = count(*) FILTER (WHERE stage = 1 AND yards <> 13)
                  THEN round((coalesce(sum(CASE WHEN stage = 1 THEN yards * 60 + stage END), 0)) / 60, 6) END AS minutes
      FROM plays GROUP BY ALL""",
)
def conditional_aggs(spark, sf):
    kind, first = F.col("kind"), F.col("stage") == 1
    # a yardage of 13 stands for a missing clock reading
    p = plays(spark, sf).withColumn("mins", F.when(F.col("yards") != 13, F.col("yards")))
    return p.groupBy(*MONTH).agg(
        F.round(aggregates.sum_where(kind == "A", "points"), 2).alias("pass_points"),
        F.round(aggregates.sum_where((kind == "R") & (F.col("discount") > 0.08), "points"), 2).alias("rush_points"),
        aggregates.count_where(kind.isin("A", "R")).alias("scrimmage"),
        aggregates.count_where((kind == "N") & (F.col("yards") >= 40)).alias("long_kicks"),
        F.round(aggregates.minutes_where(first, "mins", "stage"), 6).alias("minutes"),
    )


THRESHOLDS = [5, 10, 15, 20, 25]
_THRESHOLD_SQL = ",\n".join(
    f"count(*) FILTER (WHERE {cond} AND yards >= {t}) AS {cls}_over_{t}"
    for t in THRESHOLDS
    for cls, cond in (("all", "kind IN ('A', 'R')"), ("pass", "kind = 'A'"), ("rush", "kind = 'R'"))
)


@query("threshold_counts", f"WITH {PLAYS_SQL} SELECT team, year, week, {_THRESHOLD_SQL} FROM plays GROUP BY ALL")
def threshold_counts(spark, sf):
    kind = F.col("kind")
    classes = {"all": kind.isin("A", "R"), "pass": kind == "A", "rush": kind == "R"}
    family = aggregates.threshold_family("yards", THRESHOLDS, classes, "{cls}_over_{t}")
    return plays(spark, sf).groupBy(*MONTH).agg(*family)


STAGES = {1: "first", 2: "second", 3: "third", 4: "fourth"}
_STAGE_SQL = ",\n".join(
    f"""count(*) FILTER (WHERE kind <> 'N' AND stage = {v}) AS {n}_attempts,
        count(*) FILTER (WHERE kind <> 'N' AND stage = {v} AND status = 'F') AS {n}_converted,
        round(count(*) FILTER (WHERE kind <> 'N' AND stage = {v} AND status = 'F')
              / nullif(count(*) FILTER (WHERE kind <> 'N' AND stage = {v}), 0), 6) AS {n}_efficiency"""
    for v, n in STAGES.items()
)


@query("stage_efficiency", f"WITH {PLAYS_SQL} SELECT team, year, week, {_STAGE_SQL} FROM plays GROUP BY ALL")
def stage_efficiency(spark, sf):
    counts = aggregates.stage_counts("stage", STAGES, F.col("status") == "F", F.col("kind") != "N")
    return plays(spark, sf).groupBy(*MONTH).agg(*counts).select("*", *aggregates.stage_rates(STAGES))


@query(
    "count_distinct_period",
    f"WITH {LISTENS_SQL} SELECT CAST(ts AS DATE) AS day, count(DISTINCT artist) AS artists FROM listens GROUP BY 1",
)
def count_distinct_period(spark, sf):
    rows = listens(spark, sf).withColumn("day", F.to_date("ts"))
    return aggregates.distinct_per_group(rows, ["day"], "artist", "artists")


@query(
    "conditional_distinct",
    f"""WITH {PLAYS_SQL}, p AS (SELECT *, CASE WHEN stage <> 7 THEN discount END AS d, CASE WHEN tax > 0.01 THEN drive END AS dr FROM plays)
      SELECT team, year, week, count(DISTINCT CASE WHEN d <= 0.02 THEN dr END) AS redzone,
             count(DISTINCT CASE WHEN d <= 0.02 AND kind = 'R' THEN dr END) AS redzone_rush,
             count(DISTINCT CASE WHEN d <= 0.02 THEN dr END)
               + max(CASE WHEN d IS NULL OR (d <= 0.02 AND dr IS NULL) THEN 1 ELSE 0 END) AS redzone_with_null
      FROM p GROUP BY ALL""",
)
def conditional_distinct(spark, sf):
    p = plays(spark, sf).withColumns(
        {"d": F.when(F.col("stage") != 7, F.col("discount")), "dr": F.when(F.col("tax") > 0.01, F.col("drive"))}
    )
    near = F.col("d") <= 0.02
    conditions = {"redzone": near, "redzone_rush": near & (F.col("kind") == "R"), "redzone_with_null": near}
    return aggregates.distinct_where(p, MONTH, "dr", conditions, count_null=["redzone_with_null"])


@query(
    "value_at_last",
    f"""WITH {PLAYS_SQL}, p AS (SELECT *, {PLAY_KEY_SQL} AS k FROM plays)
      SELECT team, year, week, arg_max(opp, k) AS last_opp, arg_max(points, k) AS last_points, arg_min(kind, k) AS first_kind,
             max(CASE WHEN status = 'F' THEN opp END) AS top_opp FROM p GROUP BY ALL""",
)
def value_at_last(spark, sf):
    return plays(spark, sf).groupBy(*MONTH).agg(
        aggregates.value_at_last("opp", PLAY_ORDER).alias("last_opp"),
        aggregates.value_at_last("points", PLAY_ORDER).alias("last_points"),
        aggregates.value_at_first("kind", PLAY_ORDER).alias("first_kind"),
        aggregates.text_max_where(F.col("status") == "F", "opp").alias("top_opp"),
    )


@query(
    "ratio_of_sums",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_brand, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS price_per_unit,
              round((sum(l_extendedprice) + sum(l_tax)) / nullif(sum(l_discount), 0), 6) AS both_per_discount, count(*) AS n
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def ratio_of_sums(spark, sf):
    li = table(spark, sf, "lineitem")
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    measures = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    rows = li.select("l_partkey", F.year("l_shipdate").alias("year"), *measures).join(brands, "l_partkey")
    return rows.groupBy("year", "p_brand").agg(
        aggregates.ratio_of_sums(["l_extendedprice"], "l_quantity").alias("price_per_unit"),
        aggregates.ratio_of_sums(["l_extendedprice", "l_tax"], "l_discount").alias("both_per_discount"),
        F.count(F.lit(1)).alias("n"),
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd,
                   min({c}) AS min, max({c}) AS max FROM lineitem"""
        for c in MEASURES
    ),
)
def describe_numeric(spark, sf):
    return profile.describe(table(spark, sf, "lineitem"), MEASURES)


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem"
        for i, a in enumerate(MEASURES)
        for b in MEASURES[i:]
    ),
)
def corr_matrix(spark, sf):
    return profile.correlations(table(spark, sf, "lineitem"), MEASURES)


@query(
    "cards_by_year",
    f"""WITH {CARDS_SQL}, c AS (SELECT * FROM cards WHERE release_year IS NOT NULL AND NOT regexp_matches(p_name, '^dark'))
      SELECT release_year, p_type AS colour, count(*) AS num_new_cards, round(avg(p_size), 6) AS avg_power, round(avg(p_retailprice), 6) AS avg_cost,
             round(sum(p_size) / nullif(sum(p_retailprice), 0), 6) AS power_per_cost, round(sum(p_size) / nullif(sum(length(p_name)), 0), 6) AS power_per_text
      FROM c GROUP BY ALL""",
)
def cards_by_year(spark, sf):
    c = cards(spark, sf).where(F.col("release_year").isNotNull() & ~F.col("p_name").rlike("^dark"))
    c = c.withColumn("text_num", F.length("p_name"))
    return c.groupBy("release_year", F.col("p_type").alias("colour")).agg(
        F.count(F.lit(1)).alias("num_new_cards"),
        F.round(F.avg("p_size"), 6).alias("avg_power"),
        F.round(F.avg("p_retailprice"), 6).alias("avg_cost"),
        F.round(safe_ratio(F.sum("p_size"), F.sum("p_retailprice")), 6).alias("power_per_cost"),
        F.round(safe_ratio(F.sum("p_size"), F.sum("text_num")), 6).alias("power_per_text"),
    )
