"""Joins, semi and anti joins, dense calendars, partner rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, joins, ranking
from ..session import store
from ..sources.files import table
from .registry import query
from .tables import LISTENS_SQL, TEAM_MONTHS_SQL, VOTES_SQL, PLAYS_SQL, listens, plays, team_months, votes


@query(
    "left_join_multi",
    f"""WITH {PLAYS_SQL},
     offence AS (SELECT team, year, week, round(sum(points), 2) AS points FROM plays WHERE kind = 'R' GROUP BY ALL),
     defence AS (SELECT opp AS team, year, week, round(sum(points), 2) AS allowed FROM plays WHERE kind = 'A' GROUP BY ALL)
     SELECT o.team, o.year, o.week, points, allowed, n_regionkey AS region
     FROM offence o LEFT JOIN defence d ON o.team = d.team AND o.year = d.year AND o.week = d.week
     LEFT JOIN nation ON o.team = n_name""",
)
def left_join_multi(spark, sf):
    kind = lambda k: F.when(F.col("kind") == k, F.col("points"))
    both = aggregates.two_sided(
        plays(spark, sf), "team", "opp", ["year", "week"], parts={"ran": F.sum(kind("R")), "caught": F.sum(kind("A"))},
        own={"points": F.round(F.sum("ran"), 2)}, faced={"allowed": F.round(F.sum("caught"), 2)},
    )
    # months without a run have no row of their own
    both = both.where("points IS NOT NULL")
    nations = table(spark, sf, "nation").select("n_name", F.col("n_regionkey").alias("region"))
    return joins.left_attach(both, nations, {"team": "n_name"})


@query(
    "inner_join_2key",
    """WITH shipped AS (
         SELECT n_name AS place, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice), 2) AS shipped
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
       ordered AS (
         SELECT n_name AS place, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS ordered
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
       SELECT * FROM shipped JOIN ordered USING (place, year)""",
)
def inner_join_2key(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("place"))

    def by_place(facts, side, fact_key, key, nation_key, date, value, name):
        # sum per fact key and year first: the joins then run on the small sums
        sums = facts.groupBy(F.col(fact_key).alias(key), F.year(date).alias("year")).agg(F.sum(value).alias("v"))
        named = sums.join(side.select(key, F.col(nation_key).alias("n_nationkey")), key).join(nation, "n_nationkey")
        return named.groupBy("place", "year").agg(F.round(F.sum("v"), 2).alias(name))

    shipped = by_place(
        table(spark, sf, "lineitem"), table(spark, sf, "supplier"), "l_suppkey", "s_suppkey", "s_nationkey",
        "l_shipdate", "l_extendedprice", "shipped",
    )
    ordered = by_place(
        table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "c_nationkey",
        "o_orderdate", "o_totalprice", "ordered",
    )
    return joins.inner_match(shipped, ordered, ["place", "year"])


@query(
    "semi_join_topk",
    f"""WITH {LISTENS_SQL}, sums AS (SELECT artist, round(sum(seconds), 6) AS s FROM listens GROUP BY 1),
     top AS (SELECT artist FROM (SELECT artist, rank() OVER (ORDER BY s DESC) AS r FROM sums) WHERE r <= 10)
     SELECT artist, CAST(ts AS DATE) AS day, type, round(sum(seconds) / 60, 6) AS minutes, count(*) AS plays
     FROM listens WHERE artist IN (SELECT artist FROM top) GROUP BY ALL""",
)
def semi_join_topk(spark, sf):
    rows = listens(spark, sf)
    sums = rows.groupBy("artist").agg(F.round(F.sum("seconds"), 6).alias("s"))
    top = ranking.top_n(sums, 10, [F.desc("s")])
    return (
        joins.keep_matching(rows, top, ["artist"])
        .groupBy("artist", F.to_date("ts").alias("day"), "type")
        .agg(F.round(F.sum("seconds") / 60, 6).alias("minutes"), F.count(F.lit(1)).alias("plays"))
    )


@query(
    "anti_join_reconcile",
    f"""WITH {VOTES_SQL}, totals AS (SELECT * FROM votes WHERE party = 'P'),
     parts AS (SELECT place, month, mode, sum(votes) AS votes, avg(votes) AS mean_votes
               FROM (SELECT * FROM votes WHERE party <> 'P') v
               WHERE NOT EXISTS (SELECT 1 FROM totals t WHERE t.place = v.place AND t.month = v.month)
               GROUP BY ALL)
     SELECT place, month, mode, round(votes, 6) AS votes, round(mean_votes, 6) AS mean_votes FROM parts
     UNION ALL SELECT place, month, mode, round(votes, 6), round(votes, 6) FROM totals""",
)
def anti_join_reconcile(spark, sf):
    v = votes(spark, sf).withColumn("mean_votes", F.col("votes"))
    out = aggregates.total_or_parts(
        v, unit=["place", "month"], group=["place", "month", "mode"], is_total=F.col("party") == "P",
        sums=["votes"], means=["mean_votes"],
    )
    return out.withColumns({c: F.round(c, 6) for c in ("votes", "mean_votes")})


@query(
    "having_semi_join",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (
         SELECT o_custkey FROM orders GROUP BY 1 HAVING round(sum(o_totalprice), 2) > 2500000)""",
)
def having_semi_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    total = F.round(F.sum("o_totalprice"), 2).alias("total")
    return joins.having_members(o, ["o_custkey"], F.col("total") > 2500000, total)


CALENDAR_SQL = """facts AS (
  SELECT o_custkey AS team, CAST(year(o_orderdate) AS INTEGER) AS year, nullif(c_mktsegment, 'BUILDING') AS conference,
         CAST(month(o_orderdate) AS INTEGER) AS week, count(*) AS games, round(sum(o_totalprice), 2) AS points,
         CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS win_flag
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
grid AS (SELECT team, year, conference, CAST(week AS INTEGER) AS week
         FROM (SELECT DISTINCT team, year, conference FROM facts) CROSS JOIN range(1, 13) t(week)),
dense AS (
  SELECT g.team, g.year, g.conference, g.week, games, points, coalesce(win_flag, 0) AS win_flag
  FROM grid g LEFT JOIN facts f ON g.team = f.team AND g.year = f.year AND g.week = f.week
       AND g.conference IS NOT DISTINCT FROM f.conference)"""


def customer_calendar(spark, sf):
    """Customers' months, one row for every month of a year they ordered in."""
    c = table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("conference"))
    o = table(spark, sf, "orders")
    facts = (
        o.groupBy(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("week"))
        .agg(
            F.count(F.lit(1)).alias("games"), F.round(F.sum("o_totalprice"), 2).alias("points"),
            F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("win_flag"),
        )
        .join(c.withColumnRenamed("c_custkey", "team"), "team")
    )
    # the grid and the facts both come from it
    return joins.densify(
        store(facts, "customer-months"), ["team", "year", "conference"], "week", 1, 12, zero_fill=["win_flag"], null_safe=["conference"]
    )


@query("calendar_densify", f"WITH {CALENDAR_SQL} SELECT * FROM dense")
def calendar_densify(spark, sf):
    return customer_calendar(spark, sf)


@query(
    "partner_self_join",
    f"""WITH {TEAM_MONTHS_SQL}
     SELECT a.team, a.opponent, a.year, a.week, a.points, b.points AS points_opponent, b.win_flag AS win_flag_opponent
     FROM months a LEFT JOIN months b ON a.opponent = b.team AND a.year = b.year AND a.week = b.week""",
)
def partner_self_join(spark, sf):
    months = team_months(spark, sf).select("team", "opponent", "year", "week", "points", "win_flag")
    m = store(months, "months")
    out = joins.partner_rows(m, "team", "opponent", ["year", "week"], ["points", "win_flag"])
    return out.drop("win_flag")
