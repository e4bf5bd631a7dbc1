"""The base tables the queries share, each in Spark and as a SQL fragment."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates
from ..sources.files import table

# a line of an order is a play: supplier nation attacks, customer nation defends
PLAY_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def plays(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    home = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team"))
    away = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("opp"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(home, "s_nationkey")
        .join(away, "c_nationkey")
        .select(
            "team", "opp",
            F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("week"),
            F.col("l_orderkey").alias("game"), F.col("l_partkey").alias("drive"),
            F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"),
            F.col("l_linenumber").alias("stage"),
            F.col("l_quantity").alias("yards"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
            F.col("l_extendedprice").alias("points"),
            *PLAY_ORDER,
        )
    )


PLAYS_SQL = """plays AS (
  SELECT sn.n_name AS team, cn.n_name AS opp,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS week,
         l_orderkey AS game, l_partkey AS drive, l_returnflag AS kind, l_linestatus AS status,
         l_linenumber AS stage, l_quantity AS yards, l_discount AS discount, l_tax AS tax,
         l_extendedprice AS points,
         l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
)"""

PLAY_KEY_SQL = "ROW(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


def whole(c):
    """Whole units of a sum of cents; sums of these are exact in any order."""
    return F.floor(c + 0.005).cast("double")


def team_months(spark: SparkSession, sf: str) -> DataFrame:
    """One row per team and month: its last opponent, points, yards, allowed sums, flags."""
    both = aggregates.two_sided(
        plays(spark, sf), "team", "opp", ["year", "week"],
        parts={"points": F.sum("points"), "yards": F.sum("yards"), "plays": F.count(F.lit(1)), "last": F.max(F.struct(*PLAY_ORDER))},
        own={
            "last_opp": F.max_by("opp", "last"), "points": whole(F.sum("points")), "yards": F.round(F.sum("yards"), 2), "plays": F.sum("plays"),
        },
        faced={"allowed_points": whole(F.sum("points")), "allowed_yards": F.round(F.sum("yards"), 2)},
    )
    # a team that met itself has no opponent that month
    return both.select(
        "team", "year", "week",
        F.nullif("last_opp", "team").alias("opponent"),
        "points", "yards", "plays", "allowed_points", "allowed_yards",
        (F.col("points") > F.col("allowed_points")).cast("int").alias("win_flag"),
        (F.col("points") <= F.col("allowed_points")).cast("int").alias("loss_flag"),
    )


TEAM_MONTHS_SQL = (
    PLAYS_SQL
    + f""",
offence AS (
  SELECT team, year, week, arg_max(opp, {PLAY_KEY_SQL}) AS last_opp, floor(sum(points) + 0.005) AS points,
         round(sum(yards), 2) AS yards, count(*) AS plays
  FROM plays GROUP BY ALL
),
defence AS (
  SELECT opp AS team, year, week, floor(sum(points) + 0.005) AS allowed_points, round(sum(yards), 2) AS allowed_yards
  FROM plays GROUP BY ALL
),
months AS (
  SELECT o.team, o.year, o.week, nullif(last_opp, o.team) AS opponent, points, yards, plays,
         allowed_points, allowed_yards,
         CAST(points > allowed_points AS INTEGER) AS win_flag,
         CAST(points <= allowed_points AS INTEGER) AS loss_flag
  FROM offence o LEFT JOIN defence d ON o.team = d.team AND o.year = d.year AND o.week = d.week
)"""
)


def listens(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("artist"), F.col("event_type").alias("type"), F.col("value").alias("seconds")
    )


LISTENS_SQL = "listens AS (SELECT event_id, ts, user_id AS artist, event_type AS type, value AS seconds FROM events)"
BLOCK_WEEK_SQL = "CAST(floor((dayofyear({c}) - 1) / 7.0) + 1 AS INTEGER)"


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as cards; the first year a part was shipped is its set's year."""
    years = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min(F.year("l_shipdate")).alias("release_year")
    )
    return table(spark, sf, "part").join(years, "p_partkey", "left")


CARDS_SQL = """cards AS (
  SELECT part.*, y.release_year FROM part
  LEFT JOIN (SELECT l_partkey, min(CAST(year(l_shipdate) AS INTEGER)) AS release_year FROM lineitem GROUP BY 1) y
  ON p_partkey = l_partkey
)"""


def votes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    o = table(spark, sf, "orders")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, "c_nationkey")
        .select(
            "place", "o_orderkey", "o_custkey", F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderstatus").alias("party"),
            F.col("o_orderpriority").alias("mode"), F.col("o_totalprice").alias("votes"),
        )
    )


VOTES_SQL = """votes AS (
  SELECT n_name AS place, o_orderkey, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         o_orderstatus AS party, o_orderpriority AS mode, o_totalprice AS votes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def tabular(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as a feature table."""
    d = table(spark, sf, "documents")
    text = F.col("text")
    features = d.select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.regexp_count(text, F.lit("[,]")).cast("double").alias("commas"),
        F.regexp_count(text, F.lit("[.]")).cast("double").alias("stops"),
        F.regexp_count(text, F.lit("[0-9]")).cast("double").alias("digits"),
        F.regexp_count(text, F.lit("\\n")).cast("double").alias("lines"),
    )
    return features.join(table(spark, sf, "labels"), "doc_id")


TABULAR_SQL = """tabular AS (
  SELECT d.doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars,
         CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) AS commas,
         CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) AS stops,
         CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS DOUBLE) AS digits,
         CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS lines,
         quality, toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""
FEATURES = ["n_chars", "commas", "stops", "digits", "lines"]


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The embeddings as ML vectors in ``vec``, whole, and their number of elements; unequal widths are an error."""
    e = table(spark, sf, "embeddings")
    width = F.size("embedding")
    low, high = e.agg(F.min(width), F.max(width)).first()
    if low != high:
        raise ValueError(f"embeddings of {low} to {high} elements")
    return e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vec")), low
