"""Properties on generated tables, many of them heavily skewed to one key."""

from __future__ import annotations

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.operators import aggregates, joins, profile, ranking, reshape, windows

few = settings(max_examples=4, derandomize=True, deadline=None, suppress_health_check=list(HealthCheck))
# the key "hot" is drawn about half of the time
keys = st.one_of(st.just("hot"), st.sampled_from(["a", "b", "c"]))
values = st.one_of(st.none(), st.integers(-3, 3))
tables = st.lists(st.tuples(keys, values), min_size=1, max_size=40)


def frame(spark, rows):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "i int, k string, v int")


@few
@given(tables)
def test_top_n_contains_every_better_or_equal_row(spark, rows):
    got = {r.i for r in ranking.top_n(frame(spark, rows), 2, [F.desc_nulls_last("v")], ["k"]).collect()}
    for i, (k, v) in enumerate(rows):
        key = -10 if v is None else v
        better = sum(1 for k2, v2 in rows if k2 == k and (-10 if v2 is None else v2) > key)
        assert (i in got) == (better < 2)


@few
@given(tables)
def test_average_ranks(spark, rows):
    got = {r.i: r.rank for r in ranking.average_ranks(frame(spark, rows), "v", "rank", blocks=4).collect()}
    known = [v for _, v in rows if v is not None]
    assert set(got) == set(range(len(rows)))
    for i, (_, v) in enumerate(rows):
        assert got[i] == (None if v is None else sum(x > v for x in known) + (known.count(v) + 1) / 2)


@few
@given(tables)
def test_medians(spark, rows):
    known = [v for _, v in rows if v is not None]
    want = float(statistics.median(known)) if known else None
    for small in (10**6, 3):
        assert profile.exact_medians(frame(spark, rows), ["v"], small=small) == {"v": want}


@few
@given(tables)
def test_distinct_where(spark, rows):
    df = frame(spark, rows)
    got = {r.k: (r.n, r.m) for r in aggregates.distinct_where(df, ["k"], "v", {"n": F.col("v") > 0, "m": F.col("v") <= 1}).collect()}
    for k in {k for k, _ in rows}:
        mine = {v for k2, v in rows if k2 == k and v is not None}
        assert got[k] == (len([v for v in mine if v > 0]), len([v for v in mine if v <= 1]))


@few
@given(tables)
def test_running_totals_end_at_the_sum(spark, rows):
    df = frame(spark, rows)
    plain = windows.running_totals(df, ["k"], ["i"], {"t": "v"})
    blocked = windows.running_totals_long(df, ["k"], ["i"], {"t": "v"}, F.floor(F.col("i") / 5))
    assert {r.i: r.t for r in plain.collect()} == {r.i: r.t for r in blocked.collect()}
    for k in {k for k, _ in rows}:
        last = max(i for i, (k2, _) in enumerate(rows) if k2 == k)
        assert plain.where(F.col("i") == last).first().t == sum(v or 0 for k2, v in rows if k2 == k)


@few
@given(tables)
def test_group_minimum(spark, rows):
    got = {r.i for r in ranking.at_group_min(frame(spark, rows), ["k"], "v").collect()}
    for i, (k, v) in enumerate(rows):
        known = [v2 for k2, v2 in rows if k2 == k and v2 is not None]
        assert (i in got) == (v is not None and v == min(known))


@few
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from("xy"), st.integers(0, 9)), min_size=1, max_size=20, unique_by=lambda r: r[:2]))
def test_pivot_and_back(spark, rows):
    df = spark.createDataFrame(rows, "k int, c string, v int")
    wide = reshape.to_wide(df, ["k"], "c", ["x", "y"], ["v"], ["v"])
    back = reshape.to_long(wide, ["k"], ["v_x", "v_y"], ["m", "c"], "v").where("v is not null")
    assert sorted((r.k, r.c, r.v) for r in back.collect()) == sorted(rows)


@few
@given(tables)
def test_semi_and_anti_split_the_rows(spark, rows):
    df = frame(spark, rows)
    members = df.where("v > 0")
    inside, outside = joins.keep_matching(df, members, ["k"]), joins.drop_matching(df, members, ["k"])
    assert sorted(r.i for r in inside.unionByName(outside).collect()) == list(range(len(rows)))


@pytest.mark.parametrize("n", [1, 9])
def test_grid_has_every_period_once(spark, n):
    df = spark.createDataFrame([("hot", i % 3) for i in range(n)], "k string, w int").distinct()
    out = joins.densify(df.withColumn("flag", F.lit(1)), ["k"], "w", 0, 4, zero_fill=["flag"]).collect()
    assert sorted(r.w for r in out) == [0, 1, 2, 3, 4] and sum(r.flag for r in out) == min(n, 3)
