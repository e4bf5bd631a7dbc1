"""Scans, sinks and whole-frame unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.columns import codes_to_wide
from ..operators.sets import bind_rows, distinct_rows
from ..session import scratch_path
from ..sources.files import (
    read_delimited,
    read_json,
    read_seasons,
    table,
    write_by_year,
    write_delimited,
    write_json,
)
from .registry import query


@query("scan_csv_roundtrip", "SELECT * FROM orders")
def scan_csv_roundtrip(spark, sf):
    orders = table(spark, sf, "orders")
    path = write_delimited(orders, scratch_path(spark, "csv"))
    return read_delimited(spark, path, orders.schema)


#: Missing text in a delimited file whose empty texts stay empty; a value that reads the same counts as missing.
MISSING = "\\N"

_AWKWARD = "concat_ws('', chr(34), source, chr(34), chr(10), ' ', left(text, 1), ',', chr(13), chr(10), chr(92), ' ')"


@query(
    "scan_csv_multiline",
    f"SELECT *, CASE WHEN n_chars % 3 = 0 THEN '' WHEN n_chars % 3 = 1 THEN {_AWKWARD} END AS awkward FROM documents",
)
def scan_csv_multiline(spark, sf):
    """Texts with line breaks, quotes, delimiters, escapes and outer spaces; empty and missing ones stay apart."""
    third = F.col("n_chars") % 3
    docs = table(spark, sf, "documents").withColumn("awkward", F.when(third == 0, "").when(third == 1, F.expr(_AWKWARD)))
    path = write_delimited(docs, scratch_path(spark, "csv-multiline"), null_text=MISSING)
    return read_delimited(spark, path, docs.schema, null_text=MISSING, multi_line=True, line_end="\n")


@query(
    "json_flatten",
    """SELECT event_id, user_id, event_type, value, ts,
              CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""",
)
def json_flatten(spark, sf):
    events = table(spark, sf, "events").withColumn("props", F.from_json("props", "k long"))
    path = write_json(events, scratch_path(spark, "json"))
    return read_json(spark, path, events.schema, multi_line=False)


@query(
    "seasons_by_folder",
    """SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year
       FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998""",
)
def seasons_by_folder(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year")
    )
    path = write_by_year(orders, scratch_path(spark, "seasons"))
    return read_seasons(spark, path, 1996, 1998)


@query(
    "union_by_name",
    """SELECT o_orderkey, o_custkey, o_totalprice, CAST(NULL AS VARCHAR) AS era
       FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
       UNION ALL BY NAME
       SELECT o_totalprice, o_orderkey, o_custkey, 'late' AS era
       FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def union_by_name(spark, sf):
    orders = table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    early = orders.where(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", "o_totalprice")
    late = orders.where(F.col("o_orderdate") >= cut).select(
        "o_totalprice", "o_orderkey", "o_custkey", F.lit("late").alias("era")
    )
    return bind_rows(early, late)


@query(
    "code_rename_wide",
    """SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS accepted,
              sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS open,
              sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS refused
       FROM lineitem GROUP BY 1""",
)
def code_rename_wide(spark, sf):
    names = {"A": "accepted", "N": "open", "R": "refused"}
    return codes_to_wide(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", names)


@query("distinct_rows", "SELECT DISTINCT p_name, p_type FROM part")
def distinct_names(spark, sf):
    return distinct_rows(table(spark, sf, "part"), ["p_name", "p_type"])
