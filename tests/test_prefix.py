"""Running sums over ranges, ranks and medians built on them, reconciliation in one scan: against plain Python."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import aggregates, prefix, profile, ranking, windows


def sums(rows):
    """rows: (group, order, value) -> {(group, order): running sum}."""
    out = {}
    for g, members in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])), key=lambda r: r[0]):
        total = 0
        for _, o, v in members:
            total += v or 0
            out[g, o] = total
    return out


@pytest.mark.parametrize("kind", ["one group", "mixed", "missing values"])
def test_prefix_sums(spark, kind):
    r = random.Random(3)
    group = {"one group": lambda: "a", "mixed": lambda: r.choice(["a", "a", "a", "b", "c", None]), "missing values": lambda: r.choice("ab")}[kind]
    rows = [(group(), i, None if kind == "missing values" and i % 3 else r.randint(-9, 9)) for i in r.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    for rows_per_task in (40, 10_000):
        got = prefix.prefix_sums(df, ["g"], ["o"], {"t": "v"}, rows_per_task)
        assert got.columns == ["g", "o", "v", "t"]
        assert {(x.g, x.o): x.t for x in got.collect()} == sums(rows)


def test_ranges_are_even(spark):
    """One key, and one value everywhere: rows a task stay near the argument."""
    one = spark.range(20_000).select(F.lit("a").alias("g"), F.lit(1).alias("o"), F.lit(2).alias("v")).repartition(4)
    parts = prefix.in_ranges(one, ["g", "o"], 20).groupBy("__part").count().collect()
    assert len(parts) >= 15 and max(p["count"] for p in parts) <= 3_000
    totals = prefix.prefix_sums(one, ["g"], ["o"], {"t": "v"}, rows_per_task=1_000).select("t").orderBy("t").collect()
    assert [x.t for x in totals] == list(range(2, 40_001, 2))


def test_long_histories(spark):
    rows = [("a" if i % 10 else "b", i, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v double")
    out = windows.running_totals_long(df, ["g"], ["o"], {"t": "v"}, rows_per_task=100)
    assert {(x.g, x.o): x.t for x in out.collect()} == sums(rows)


@pytest.mark.parametrize("values", [[5] * 400, list(range(400)), [1, 1, 2, None, 3, 3, 3], []])
def test_ranks_and_medians(spark, values):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, v double")
    known = sorted((v for v in values if v is not None), reverse=True)
    want = {i: None if v is None else known.index(v) + 1 + (known.count(v) - 1) / 2 for i, v in enumerate(values)}
    assert {x.i: x.rank for x in ranking.average_ranks(df, "v", "rank", rows_per_task=30).collect()} == want
    middle = None if not known else (sorted(known)[(len(known) - 1) // 2] + sorted(known)[len(known) // 2]) / 2
    assert profile.exact_medians(df, ["v"], small=20) == {"v": middle}


def test_total_or_parts_cases(spark):
    rows = [
        ("x", "c1", "TOTAL", 10, 1.0), ("x", "c1", "TOTAL", 10, 1.0), ("x", "c2", "part", 4, 2.0), ("y", "c1", "part", 1, 3.0), ("y", "c1", "part", 2, None),
        ("y", "c2", "part", None, None), (None, "c1", "part", 7, 5.0), (None, "c9", "TOTAL", 8, 6.0), ("z", "c1", None, 9, 9.0),
    ]
    df = spark.createDataFrame(rows, "state string, county string, mode string, v long, t double")
    out = aggregates.total_or_parts(df, ["state"], ["state", "county"], F.col("mode") == "TOTAL", ["v"], ["t"])
    want = [("x", "c1", 10, 1.0), ("x", "c1", 10, 1.0), ("y", "c1", 3, 3.0), ("y", "c2", None, None), (None, "c1", 7, 5.0), (None, "c9", 8, 6.0)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    over = aggregates.total_or_parts(df, ["state"], ["county"], F.col("mode") == "TOTAL", ["v"], ["t"])
    assert sorted(map(str, map(tuple, over.collect()))) == sorted(map(str, [("c1", 10, 1.0), ("c1", 10, 1.0), ("c1", 10, 4.0), ("c2", None, None), ("c9", 8, 6.0)]))


def test_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("t", F.col("o_totalprice"))
    out = aggregates.total_or_parts(df, ["o_custkey"], ["o_custkey", "o_orderstatus"], F.col("o_orderpriority") == "1-URGENT", ["o_totalprice"], ["t"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
