"""Projection, filters, recoding, missing values and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, numeric, text
from ..functions.nulls import differs_or_null
from ..operators import columns, pruning
from ..sources.files import table
from .registry import query
from .tables import BLOCK_WEEK_SQL


@query(
    "project_rename",
    """SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS supplier,
              round(l_extendedprice * (1 - l_discount), 6) AS net,
              round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem""",
)
def project_rename(spark, sf):
    lines = columns.rename_codes(
        table(spark, sf, "lineitem"),
        {"l_orderkey": "order_id", "l_linenumber": "line", "l_suppkey": "supplier", "l_extendedprice": "price",
         "l_discount": "discount", "l_tax": "tax"},
    )
    net = F.col("price") * (1 - F.col("discount"))
    return lines.select("order_id", "line", "supplier", F.round(net, 6).alias("net"), F.round(net * (1 + F.col("tax")), 6).alias("gross"))


@query(
    "filter_predicates",
    """SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')
         AND (o_totalprice > 100000 OR o_custkey < 500)
         AND year(o_orderdate) <= year(DATE '1999-06-30') - 1""",
)
def filter_predicates(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & ~F.col("o_orderstatus").isin("P")
        & ((F.col("o_totalprice") > 100000) | (F.col("o_custkey") < 500))
        & calendar.up_to_last_year("o_orderdate", "1999-06-30")
    ).select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")


@query(
    "filter_null_keep",
    """WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind,
                         CASE WHEN value < 5 THEN NULL ELSE value END AS amount FROM events)
       SELECT * FROM e WHERE (kind <> 'view' OR kind IS NULL) AND NOT (kind IS NULL AND amount IS NULL)""",
)
def filter_null_keep(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("kind"),
        F.when(F.col("value") >= 5, F.col("value")).alias("amount"),
    )
    return e.where(differs_or_null("kind", "view")).dropna(how="all", subset=["kind", "amount"])


@query(
    "regex_filter",
    """SELECT p_partkey, p_name, p_brand FROM part
       WHERE regexp_matches(p_name, '^red|^blue') AND NOT regexp_matches(p_name, '[xz]')""",
)
def regex_filter(spark, sf):
    p = table(spark, sf, "part")
    return p.where(F.col("p_name").rlike("^red|^blue") & ~F.col("p_name").rlike("[xz]")).select("p_partkey", "p_name", "p_brand")


@query(
    "case_when",
    """SELECT * FROM (
         SELECT p_partkey, p_size, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS is_big,
                CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 20 THEN 'medium' WHEN p_size <= 40 THEN 'large' END AS size_class
         FROM part) WHERE size_class <> 'medium'""",
)
def case_when(spark, sf):
    size = F.col("p_size")
    classes = F.when(size <= 10, "small").when(size <= 20, "medium").when(size <= 40, "large")
    p = table(spark, sf, "part").select(
        "p_partkey", "p_size", F.when(size > 25, 1).otherwise(0).alias("is_big"), classes.alias("size_class")
    )
    return p.where(F.col("size_class") != "medium")


@query(
    "recode_map",
    """SELECT o_orderkey,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
                   WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS priority,
              CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'pending large' ELSE o_orderstatus END AS state
       FROM orders""",
)
def recode_map(spark, sf):
    o = table(spark, sf, "orders")
    fix = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000)
    return o.select(
        "o_orderkey",
        columns.recode("o_orderpriority", {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}).alias("priority"),
        F.when(fix, "pending large").otherwise(F.col("o_orderstatus")).alias("state"),
    )


SPARSE_SQL = """sparse AS (
  SELECT o_orderkey, o_totalprice,
         CASE WHEN o_orderstatus = 'P' THEN o_orderstatus END AS partial_state,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS rush,
         CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS open_date
  FROM orders)"""


def sparse_orders(spark, sf):
    """Orders with columns made partly missing."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.when(status == "P", status).alias("partial_state"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), priority).alias("rush"),
        F.when(status != "F", F.col("o_orderdate")).alias("open_date"),
    )


@query("null_prune_columns", f"WITH {SPARSE_SQL} SELECT o_orderkey, o_totalprice, rush, open_date FROM sparse")
def null_prune_columns(spark, sf):
    return pruning.prune_columns(sparse_orders(spark, sf), 0.65)


@query(
    "null_prune_rows",
    f"""WITH {SPARSE_SQL}, shares AS (
         SELECT *, (CAST(partial_state IS NULL AS INTEGER) + CAST(rush IS NULL AS INTEGER)
                    + CAST(open_date IS NULL AS INTEGER)) / 5.0 AS share FROM sparse)
       SELECT o_orderkey, o_totalprice, partial_state, rush, open_date, 'share' AS rule FROM shares WHERE share <= 0.4
       UNION ALL
       SELECT o_orderkey, o_totalprice, partial_state, rush, open_date, 'complete' AS rule FROM shares WHERE share = 0""",
)
def null_prune_rows(spark, sf):
    s = sparse_orders(spark, sf)
    kept = pruning.prune_rows(s, 0.4).withColumn("rule", F.lit("share"))
    return kept.unionByName(pruning.complete_rows(s).withColumn("rule", F.lit("complete")))


@query(
    "null_profile",
    f"""WITH {SPARSE_SQL}, counts AS (SELECT count(*) AS n, count(o_orderkey) AS a, count(o_totalprice) AS b,
           count(partial_state) AS c, count(rush) AS d, count(open_date) AS e FROM sparse)
       SELECT column_name, n - present AS missing, round((n - present) / n, 6) AS missing_share FROM (
         SELECT 'o_orderkey' AS column_name, n, a AS present FROM counts UNION ALL
         SELECT 'o_totalprice', n, b FROM counts UNION ALL SELECT 'partial_state', n, c FROM counts UNION ALL
         SELECT 'rush', n, d FROM counts UNION ALL SELECT 'open_date', n, e FROM counts)""",
)
def null_profile(spark, sf):
    return pruning.null_profile(sparse_orders(spark, sf))


@query(
    "blank_to_null",
    """SELECT c_custkey, c_name,
              coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE c_mktsegment END, ' '), 'Missing_value') AS segment,
              CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer""",
)
def blank_to_null(spark, sf):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" ")).otherwise(F.col("c_mktsegment"))
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_name", segment.alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")
    )
    return columns.fill_constants(columns.blanks_to_null(c), 0, "Missing_value")


@query("select_by_type", "SELECT p_partkey, p_size, p_retailprice, p_type AS p_type_text FROM part")
def select_by_type(spark, sf):
    p = table(spark, sf, "part")
    renamed = p.withColumnsRenamed({"p_size": "P Size", "p_retailprice": "pRetailprice", "p_type": "p_type (text)"})
    wanted = columns.numeric_columns(renamed) + columns.prefixed_columns(renamed, "P_Type")
    return columns.clean_names(renamed.select(*[F.col(f"`{c}`") for c in wanted]))


@query(
    "schema_align",
    """SELECT CAST(0 AS BIGINT) AS custkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal, '0' AS mktsegment FROM supplier""",
)
def schema_align(spark, sf):
    def strip(df):
        return df.toDF(*[c.split("_", 1)[1] for c in df.columns])

    return columns.align_to(strip(table(spark, sf, "supplier")), strip(table(spark, sf, "customer")))


@query(
    "string_clean",
    """SELECT c_custkey, upper(trim(split_part(c_name, '#', 2))) AS code,
              trim(regexp_replace(upper(c_name), 'CUSTOMER', '')) AS tail,
              regexp_replace(c_name, '[^a-zA-Z0-9]', '_', 'g') AS cleaned FROM customer""",
)
def string_clean(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", text.part("c_name", "#", 1).alias("code"),
        text.remove_first(F.upper("c_name"), "CUSTOMER").alias("tail"), text.alnum_only("c_name").alias("cleaned"),
    )


@query(
    "string_measures",
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS text_num,
              CAST(length(text) - length(replace(text, ',', '')) AS INTEGER) AS commas,
              TRY_CAST(regexp_replace(source, '^src', '') AS DOUBLE) AS source_number,
              TRY_CAST(lang AS DOUBLE) AS lang_number,
              printf('%.2f', n_chars / 7.0) AS words_guess, lang || ', ' || source AS label FROM documents""",
)
def string_measures(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.length("text").alias("text_num"), text.char_count("text", ",").alias("commas"),
        text.tolerant_number(F.regexp_replace("source", "^src", "")).alias("source_number"),
        text.tolerant_number("lang").alias("lang_number"),
        text.fixed_decimals(F.col("n_chars") / 7.0, 2).alias("words_guess"), text.joined_label("lang", "source").alias("label"),
    )


@query(
    "calendar_parts",
    f"""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
              {BLOCK_WEEK_SQL.format(c='o_orderdate')} AS week, CAST(dayofyear(o_orderdate) AS INTEGER) AS day,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS month_year,
              o_orderdate AS parsed FROM orders""",
)
def calendar_columns(spark, sf):
    o = table(spark, sf, "orders")
    parts = [c.alias(n) for n, c in calendar.calendar_parts("o_orderdate").items()]
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select("o_orderkey", *parts, calendar.parse_utc(iso).alias("parsed"))


@query(
    "math_scalars",
    """SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price, round(exp(ln(o_totalprice) / 10), 6) AS exp_tenth,
              round_even(o_totalprice / 1000, 0) AS thousands, abs(o_totalprice - 150000) AS gap, -o_totalprice AS flipped,
              round(ln(CASE WHEN o_orderstatus = 'P' THEN 0.1 ELSE o_totalprice END), 6) AS floored FROM orders""",
)
def math_scalars(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(F.ln(price), 6).alias("log_price"), F.round(F.exp(F.ln(price) / 10), 6).alias("exp_tenth"),
        numeric.half_even(price / 1000).alias("thousands"), F.abs(price - 150000).alias("gap"), (-price).alias("flipped"),
        F.round(numeric.floored_log(F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(price)), 6).alias("floored"),
    )


BREAKS = [0.0, 0.02, 0.04, 0.06, 0.08, 0.1]


@query(
    "interval_bins",
    """SELECT l_returnflag, bin, count(*) AS n FROM (
         SELECT l_returnflag, CASE WHEN l_discount >= 0 AND l_discount < 0.02::DOUBLE THEN '0 to 0.02'
            WHEN l_discount >= 0.02::DOUBLE AND l_discount < 0.04::DOUBLE THEN '0.02 to 0.04'
            WHEN l_discount >= 0.04::DOUBLE AND l_discount < 0.06::DOUBLE THEN '0.04 to 0.06'
            WHEN l_discount >= 0.06::DOUBLE AND l_discount < 0.08::DOUBLE THEN '0.06 to 0.08'
            WHEN l_discount >= 0.08::DOUBLE AND l_discount <= 0.1::DOUBLE THEN '0.08 to 0.1' END AS bin FROM lineitem)
       GROUP BY ALL""",
)
def interval_bins(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", numeric.interval_bin("l_discount", BREAKS).alias("bin"))
    return lines.groupBy("l_returnflag", "bin").agg(F.count(F.lit(1)).alias("n"))
