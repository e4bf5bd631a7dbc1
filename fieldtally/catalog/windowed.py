"""Running totals, lags, ranks, z-scores, first rows and weighting."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.nulls import safe_ratio
from ..operators import joins, ranking, windows
from ..operators.profile import correlations_with
from ..session import store
from ..sources.files import table
from .joined import CALENDAR_SQL, customer_calendar
from .registry import query
from .tables import BLOCK_WEEK_SQL, CARDS_SQL, LISTENS_SQL, TEAM_MONTHS_SQL, cards, listens, team_months

SEASON, ORDER = ["team", "year"], ["week"]


@query(
    "running_totals",
    f"""WITH {LISTENS_SQL}, daily AS (SELECT artist, CAST(ts AS DATE) AS day, round(sum(seconds), 6) AS s FROM listens GROUP BY ALL)
      SELECT artist, day, s AS seconds, round(sum(s) OVER (PARTITION BY artist ORDER BY day) / 3600, 6) AS total_hours FROM daily""",
)
def running_totals(spark, sf):
    daily = listens(spark, sf).groupBy("artist", F.to_date("ts").alias("day")).agg(F.round(F.sum("seconds"), 6).alias("seconds"))
    out = windows.running_totals(daily, ["artist"], ["day"], {"total": "seconds"})
    return out.select("artist", "day", "seconds", F.round(F.col("total") / 3600, 6).alias("total_hours"))


@query(
    "running_totals_long",
    f"""WITH {LISTENS_SQL} SELECT event_id, artist, round(sum(seconds) OVER (PARTITION BY type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS so_far
       FROM listens""",
)
def running_totals_long(spark, sf):
    """Per event type over raw events: a few long histories, cut by ranges of (type, time) of equal size."""
    out = windows.running_totals_long(listens(spark, sf), ["type"], ["ts", "event_id"], {"so_far": "seconds"}, rows_per_task=50_000)
    return out.select("event_id", "artist", F.round("so_far", 4).alias("so_far"))


_RUN = "OVER (PARTITION BY team, year ORDER BY week)"


@query(
    "running_ratios",
    f"""WITH {CALENDAR_SQL}, run AS (SELECT team, year, conference, week, sum(coalesce(games, 0)) OVER w AS cum_games, sum(win_flag) OVER w AS cum_wins,
          sum(coalesce(points, 0)) OVER w AS cum_points FROM dense WINDOW w AS (PARTITION BY team, year ORDER BY week))
      SELECT team, year, week, CAST(cum_games AS BIGINT) AS cum_games, CAST(cum_wins AS BIGINT) AS cum_wins,
             round(cum_points, 2) AS cum_points, round(cum_wins / nullif(cum_games, 0), 6) AS win_rate,
             round(cum_points / nullif(cum_games, 0), 6) AS points_per_game FROM run""",
)
def running_ratios(spark, sf):
    dense = customer_calendar(spark, sf)
    run = windows.running_totals(dense, SEASON, ORDER, {"cum_games": "games", "cum_wins": "win_flag", "cum_points": "points"})
    return run.select(
        "team", "year", "week", "cum_games", "cum_wins", F.round("cum_points", 2).alias("cum_points"),
        F.round(safe_ratio("cum_wins", "cum_games"), 6).alias("win_rate"),
        F.round(safe_ratio("cum_points", "cum_games"), 6).alias("points_per_game"),
    )


@query(
    "running_totals_unpivoted",
    f"""WITH {TEAM_MONTHS_SQL} SELECT team, year, week, round(sum(points) {_RUN}, 2) AS cum_points, round(sum(yards) {_RUN}, 2) AS cum_yards,
         CAST(sum(plays) {_RUN} AS DOUBLE) AS cum_plays FROM months""",
)
def running_totals_unpivoted(spark, sf):
    out = windows.running_totals_unpivoted(team_months(spark, sf), SEASON, "week", ["points", "yards", "plays"])
    return out.withColumns({c: F.round(c, 2) for c in ("cum_points", "cum_yards")})


@query(
    "lag_default",
    f"""WITH {CALENDAR_SQL} SELECT team, year, week, coalesce(lag(points) OVER w, 0) AS lagged_points,
          round(coalesce(lag(ln(points)) OVER w, ln(0.1)), 6) AS lagged_log, lag(win_flag) OVER w AS lagged_flag
      FROM dense WINDOW w AS (PARTITION BY team, year ORDER BY week)""",
)
def lag_default(spark, sf):
    dense = customer_calendar(spark, sf).withColumn("log_points", F.ln("points"))
    lags = windows.lagged(
        SEASON, ORDER,
        {"lagged_points": ("points", 0.0), "lagged_log": ("log_points", math.log(0.1)), "lagged_flag": ("win_flag", None)},
    )
    return dense.select(
        "team", "year", "week", lags["lagged_points"].alias("lagged_points"),
        F.round(lags["lagged_log"], 6).alias("lagged_log"), lags["lagged_flag"].alias("lagged_flag"),
    )


@query(
    "topn_per_group",
    f"""WITH {LISTENS_SQL}, sums AS (SELECT {BLOCK_WEEK_SQL.format(c='ts')} AS week, artist, round(sum(seconds) / 3600, 6) AS hours FROM listens GROUP BY ALL),
      ranked AS (SELECT *, CAST(rank() OVER (PARTITION BY week ORDER BY hours DESC) AS INTEGER) AS rank FROM sums)
      SELECT *, CAST(row_number() OVER (PARTITION BY week ORDER BY hours DESC, artist) AS INTEGER) AS sort_key FROM ranked WHERE rank <= 5""",
)
def topn_per_group(spark, sf):
    sums = listens(spark, sf).groupBy(calendar.block_week("ts").alias("week"), "artist").agg(
        F.round(F.sum("seconds") / 3600, 6).alias("hours")
    )
    top = ranking.top_n(sums, 5, [F.desc("hours")], ["week"])
    return ranking.panel_order(top, ["week"], [F.desc("hours"), F.asc("artist")])


@query(
    "topn_global",
    f"""WITH {LISTENS_SQL}, sums AS (SELECT artist, arg_min(type, ROW(ts, event_id)) AS first_type, round(sum(seconds) / 3600, 6) AS hours FROM listens GROUP BY 1),
      ranked AS (SELECT *, CAST(rank() OVER (ORDER BY hours DESC) AS INTEGER) AS rank FROM sums)
      SELECT artist, hours, rank, artist || ', ' || first_type AS label FROM ranked WHERE rank <= 50""",
)
def topn_global(spark, sf):
    from ..functions.text import joined_label

    sums = listens(spark, sf).groupBy("artist").agg(
        F.min_by("type", F.struct("ts", "event_id")).alias("first_type"), F.round(F.sum("seconds") / 3600, 6).alias("hours")
    )
    top = ranking.top_n(sums, 50, [F.desc("hours")])
    label = joined_label(F.col("artist").cast("string"), "first_type")
    return top.select("artist", "hours", "rank", label.alias("label")).orderBy(F.desc("hours"), "artist")


@query(
    "topk_abs",
    """SELECT feature, r FROM (
         SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL
         SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 6) FROM lineitem UNION ALL
         SELECT 'l_tax', round(corr(l_tax, l_extendedprice), 6) FROM lineitem UNION ALL
         SELECT 'l_linenumber', round(corr(l_linenumber, l_extendedprice), 6) FROM lineitem UNION ALL
         SELECT 'l_suppkey', round(corr(l_suppkey, l_extendedprice), 6) FROM lineitem)
       ORDER BY abs(r) DESC, feature LIMIT 3""",
)
def topk_abs(spark, sf):
    found = correlations_with(
        table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
    )
    return ranking.top_k_abs(found, "r", 3, "feature")


@query(
    "rank_compare",
    """WITH totals AS (SELECT o_custkey, count(*) AS n, CAST(floor(sum(o_totalprice) / 100000) AS BIGINT) AS units FROM orders GROUP BY 1),
       ranked AS (SELECT o_custkey,
          rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS predicted_rank,
          rank() OVER (ORDER BY units DESC) + (count(*) OVER (PARTITION BY units) - 1) / 2 AS actual_rank FROM totals)
       SELECT *, actual_rank - predicted_rank AS rank_difference,
              CASE WHEN actual_rank < predicted_rank THEN 'red' WHEN actual_rank > predicted_rank THEN 'green' END AS colour
       FROM ranked WHERE predicted_rank <= 25""",
)
def rank_compare(spark, sf):
    from ..plans.report import compare_ranks

    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.sum("o_totalprice") / 100000).alias("units")
    )
    return compare_ranks(totals, ["o_custkey"], "n", "units", cut=25)


@query(
    "average_ranks",
    """SELECT event_id, user_id, rank() OVER (ORDER BY value DESC) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS value_rank FROM events""",
)
def average_ranks(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return ranking.average_ranks(e, "value", "value_rank").drop("value")


@query(
    "group_zscore",
    """WITH o AS (SELECT o_orderkey, o_totalprice, date_trunc('month', o_orderdate) AS m FROM orders)
       SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 6) AS z
       FROM o WINDOW w AS (PARTITION BY m)""",
)
def group_zscore(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", calendar.month_start("o_orderdate").alias("m"))
    return windows.group_zscores(o, ["m"], {"z": "o_totalprice"}, digits=6).select("o_orderkey", "z")


@query(
    "group_min_filter",
    f"""WITH {CARDS_SQL}, c AS (SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_brand <> 'Brand#25' OR p_size > 2 THEN release_year END AS release_year FROM cards),
       g AS (SELECT p_name, p_brand, min(release_year) AS y FROM c GROUP BY ALL HAVING count(release_year) = count(*))
       SELECT c.* FROM c JOIN g ON c.p_name = g.p_name AND c.p_brand = g.p_brand AND release_year = y""",
)
def group_min_filter(spark, sf):
    # some years are made missing: they empty their whole group
    known = (F.col("p_brand") != "Brand#25") | (F.col("p_size") > 2)
    c = cards(spark, sf).select("p_partkey", "p_name", "p_brand", "p_type", F.when(known, F.col("release_year")).alias("release_year"))
    return ranking.at_group_min(c, ["p_name", "p_brand"], "release_year", null_empties_group=True)


@query(
    "dedupe_keep_first",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def dedupe_keep_first(spark, sf):
    return ranking.first_per_key(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])


_WEIGHT_SQL = f"""{TEAM_MONTHS_SQL},
  run AS (SELECT *, sum(win_flag) {_RUN} / nullif(count(opponent) {_RUN}, 0) AS win_rate,
                 sum(points) {_RUN} / nullif(count(opponent) {_RUN}, 0) AS avg_points,
                 sum(coalesce(allowed_points, 0)) {_RUN} / nullif(count(opponent) {_RUN}, 0) AS avg_allowed,
                 sum(points - coalesce(allowed_points, 0)) {_RUN} AS margin FROM months)"""


def rated_months(spark, sf):
    # the months meet themselves: stored once instead of summed on both sides
    m = store(team_months(spark, sf), "months")
    run = windows.running_totals(
        m, SEASON, ORDER,
        {"wins": "win_flag", "games": F.col("opponent").isNotNull().cast("int"), "cum_points": "points", "cum_allowed": "allowed_points",
         "margin": F.col("points") - F.coalesce("allowed_points", F.lit(0))},
    )
    rates = {"win_rate": "wins", "avg_points": "cum_points", "avg_allowed": "cum_allowed"}
    return run.withColumns({n: safe_ratio(c, "games") for n, c in rates.items()})


@query(
    "partner_weighting",
    f"""WITH {_WEIGHT_SQL}
      SELECT a.team, a.year, a.week, a.opponent, a.points * b.win_rate AS weighted_points, a.yards * b.win_rate AS weighted_yards,
             a.win_flag * b.win_rate AS weighted_win_flag, a.points * b.avg_allowed AS points_vs_allowed,
             a.allowed_points * b.avg_points AS allowed_vs_points, a.margin * b.margin AS margin_product
      FROM run a LEFT JOIN run b ON a.opponent = b.team AND a.year = b.year AND a.week = b.week""",
)
def partner_weighting(spark, sf):
    run = rated_months(spark, sf)
    both = joins.partner_rows(run, "team", "opponent", ["year", "week"], ["win_rate", "avg_points", "avg_allowed", "margin"])
    rate = F.col("win_rate_opponent")
    return both.select(
        "team", "year", "week", "opponent",
        (F.col("points") * rate).alias("weighted_points"), (F.col("yards") * rate).alias("weighted_yards"),
        (F.col("win_flag") * rate).alias("weighted_win_flag"),
        (F.col("points") * F.col("avg_allowed_opponent")).alias("points_vs_allowed"),
        (F.col("allowed_points") * F.col("avg_points_opponent")).alias("allowed_vs_points"),
        (F.col("margin") * F.col("margin_opponent")).alias("margin_product"),
    )


VOTE_POINTS_SQL = """poll AS (
  SELECT n_name AS team, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS week,
         round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'), 2) AS poll_points
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def poll_points(spark, sf):
    """Points a nation gets from its urgent pending orders of a month."""
    from .tables import votes

    v = votes(spark, sf)
    wanted = (F.col("party") == "P") & (F.col("mode") == "1-URGENT")
    return v.groupBy(F.col("place").alias("team"), F.year("month").alias("year"), F.month("month").alias("week")).agg(
        F.round(F.sum(F.when(wanted, F.col("votes"))), 2).alias("poll_points")
    )


@query(
    "vote_weighting",
    f"""WITH {TEAM_MONTHS_SQL}, {VOTE_POINTS_SQL},
      polled AS (SELECT m.*, CASE WHEN coalesce(poll_points, 0) = 0 THEN 0.1 ELSE poll_points END AS analytical
                 FROM months m LEFT JOIN poll p ON m.team = p.team AND m.year = p.year AND m.week = p.week),
      lagged AS (SELECT *, coalesce(lag(ln(analytical)) OVER (PARTITION BY team, year ORDER BY week), ln(0.1)) AS lagged_log FROM polled),
      joined AS (SELECT a.*, b.lagged_log AS lagged_log_opponent FROM lagged a LEFT JOIN lagged b
                 ON a.opponent = b.team AND a.year = b.year AND a.week = b.week)
      SELECT team, year, week, round(lagged_log, 6) AS lagged_log, round(points * lagged_log_opponent, 2) AS vote_points,
             round(sum(coalesce(points * lagged_log_opponent, 0)) {_RUN}, 2) AS cum_vote_points,
             round(sum(coalesce(points * lagged_log_opponent, 0)) {_RUN} / nullif(count(opponent) {_RUN}, 0), 2) AS cum_vote_points_per_game
      FROM joined""",
)
def vote_weighting(spark, sf):
    from ..functions.numeric import floored_log

    m = store(joins.left_attach(team_months(spark, sf), poll_points(spark, sf), ["team", "year", "week"]), "months")
    logged = m.withColumn("log_votes", floored_log(F.coalesce("poll_points", F.lit(0.0))))
    lags = windows.lagged(SEASON, ORDER, {"lagged_log": ("log_votes", math.log(0.1))})
    both = joins.partner_rows(logged.withColumns(lags), "team", "opponent", ["year", "week"], ["lagged_log"])
    weighted = both.withColumn("vote_points", F.col("points") * F.col("lagged_log_opponent"))
    run = windows.running_totals(
        weighted, SEASON, ORDER, {"cum_vote_points": "vote_points", "games": F.col("opponent").isNotNull().cast("int")}
    )
    return run.select(
        "team", "year", "week", F.round("lagged_log", 6).alias("lagged_log"), F.round("vote_points", 2).alias("vote_points"),
        F.round("cum_vote_points", 2).alias("cum_vote_points"),
        F.round(safe_ratio("cum_vote_points", "games"), 2).alias("cum_vote_points_per_game"),
    )
