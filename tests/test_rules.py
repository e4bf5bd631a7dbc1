"""Null, tie and rounding rules on tiny tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import calendar, nulls, numeric, text
from fieldtally.operators import aggregates, columns, joins, pruning, ranking, reshape, sets, windows


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_ratio_is_missing_on_zero(spark):
    r = one(spark, a=nulls.safe_ratio(F.lit(0), F.lit(0)), b=nulls.safe_ratio(F.lit(5), F.lit(0)), c=nulls.safe_ratio(F.lit(1), F.lit(4)))
    assert (r.a, r.b, r.c) == (None, None, 0.25)


def test_strict_greatest_and_sum(spark):
    df = spark.createDataFrame([(1, 2), (3, None)], "a int, b int")
    assert [r[0] for r in df.select(nulls.strict_greatest("a", "b")).collect()] == [2, None]
    got = df.agg(nulls.strict_sum("a").alias("a"), nulls.strict_sum("b").alias("b")).first()
    assert (got.a, got.b) == (4, None)


def test_differs_or_null_keeps_missing(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "a string")
    assert sorted(str(r.a) for r in df.where(nulls.differs_or_null("a", "x")).collect()) == ["None", "y"]


def test_half_even(spark):
    r = one(spark, a=numeric.half_even(F.lit(2.5)), b=numeric.half_even(F.lit(3.5)), c=numeric.half_even(F.lit(0.1235), 3))
    assert (r.a, r.b, r.c) == (2.0, 4.0, 0.124)


def test_block_week_is_not_iso(spark):
    days = [dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 7), dt.datetime(2021, 1, 8), dt.datetime(2020, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    assert [r[0] for r in df.select(calendar.block_week("t")).collect()] == [1, 1, 2, 53]


def test_signed_lead_and_unit(spark):
    df = spark.createDataFrame([(0.6, 0.4), (0.3, 0.7), (0.5, 0.5), (None, 0.4)], "d double, r double")
    out = df.withColumn("x", numeric.signed_lead("d", "r")).withColumn("u", numeric.unit_interval("x")).collect()
    assert [r.x for r in out] == [0.6, -0.7, -0.5, None]
    assert [None if r.u is None else round(r.u, 6) for r in out] == [0.6, 0.3, 0.5, None]


def test_bins_close_the_last_interval(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,), (None,)], "x double")
    got = [r[0] for r in df.select(numeric.interval_bin("x", [0.0, 0.5, 1.0])).collect()]
    assert got == ["0 to 0.5", "0.5 to 1", "0.5 to 1", None, None]


def test_text_rules(spark):
    r = one(
        spark, a=text.remove_first(F.lit("LAKE COUNTY COUNTY"), "COUNTY"), b=text.part(F.lit("Dane County, Wisconsin"), ",", 1),
        c=text.tolerant_number(F.lit("1*")), d=text.tolerant_number(F.lit(" 2.5")), e=text.joined_label(F.lit("a"), F.lit(None).cast("string")),
        f=text.char_count(F.lit("['W', 'U']"), ","), g=text.alnum_only(F.lit("a-b c")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("LAKE  COUNTY", "WISCONSIN", None, 2.5, "a, NA", 1, "a_b_c")


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "k string, v int")
    assert sorted(r.k for r in ranking.top_n(df, 2, [F.desc("v")]).collect()) == ["a", "b", "c"]
    assert [r.k for r in ranking.top_n_cut(df, 2, [F.desc("v"), F.asc("k")]).collect()] == ["a", "b"]


def test_average_ranks_match_brute_force(spark):
    values = [5.0, 1.0, 5.0, None, 2.0, 5.0, 2.0] + [float(i % 13) for i in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.rank for r in ranking.average_ranks(df, "v", "rank", blocks=7).collect()}
    known = [v for v in values if v is not None]
    for i, v in enumerate(values):
        want = None if v is None else sum(x > v for x in known) + (sum(x == v for x in known) + 1) / 2
        assert got[i] == want


def test_first_per_key_and_group_min(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", 5, 3), ("b", None, 4)], "k string, y int, i int")
    assert sorted((r.k, r.i) for r in ranking.first_per_key(df, ["k"], ["i"]).collect()) == [("a", 1), ("b", 3)]
    assert sorted(r.i for r in ranking.at_group_min(df, ["k"], "y").collect()) == [2, 3]
    assert [r.i for r in ranking.at_group_min(df, ["k"], "y", null_empties_group=True).collect()] == [2]


def test_value_at_last_breaks_ties(spark):
    df = spark.createDataFrame([("g", 1, 1, "x"), ("g", 2, 1, "y"), ("g", 2, 2, "z")], "g string, k int, tie int, v string")
    assert df.groupBy("g").agg(aggregates.value_at_last("v", ["k", "tie"]).alias("v")).first().v == "z"
    assert df.groupBy("g").agg(aggregates.value_at_first("v", ["k", "tie"]).alias("v")).first().v == "x"


def test_distinct_counts_a_missing_condition(spark):
    rows = [("g", 1, 10), ("g", 1, 30), ("g", 2, 15), ("g", 3, None), ("h", 4, 50), ("h", None, 5)]
    df = spark.createDataFrame(rows, "g string, d int, y int")
    cond = {"n": F.col("y") <= 20}
    plain = {r.g: r.n for r in aggregates.distinct_where(df, ["g"], "d", cond).collect()}
    with_null = {r.g: r.n for r in aggregates.distinct_where(df, ["g"], "d", cond, count_null=True).collect()}
    assert plain == {"g": 2, "h": 0} and with_null == {"g": 3, "h": 1}


def test_minutes_are_missing_when_a_flagged_part_is(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 30.0), ("a", 0, None, None), ("b", 1, None, 5.0)], "g string, f int, m double, s double")
    got = {r.g: r.x for r in df.groupBy("g").agg(aggregates.minutes_where(F.col("f") == 1, "m", "s").alias("x")).collect()}
    assert got == {"a": 2.5, "b": None}


def test_total_or_parts(spark):
    rows = [("A", "c1", "TOTAL", 10.0, 20.0), ("A", "c1", "MAIL", 4.0, 20.0), ("B", "c2", "MAIL", 3.0, 9.0), ("B", "c2", "DAY", 2.0, 11.0)]
    df = spark.createDataFrame(rows, "state string, county string, mode string, v double, t double")
    out = aggregates.total_or_parts(df, ["state"], ["state", "county"], F.col("mode") == "TOTAL", ["v"], ["t"])
    assert sorted(tuple(r) for r in out.collect()) == [("A", "c1", 10.0, 20.0), ("B", "c2", 5.0, 10.0)]


def test_null_safe_join_and_densify(spark):
    df = spark.createDataFrame([("t", 2020, None, 2, 7, 1)], "team string, year int, conf string, week int, pts int, win int")
    out = joins.densify(df, ["team", "year", "conf"], "week", 1, 3, zero_fill=["win"], null_safe=["conf"]).orderBy("week").collect()
    assert [(r.week, r.pts, r.win) for r in out] == [(1, None, 0), (2, 7, 1), (3, None, 0)]


def test_partner_rows_keep_missing_partners(spark):
    df = spark.createDataFrame([("a", "b", 1, 5), ("b", "a", 1, 6), ("c", None, 1, 7)], "team string, opp string, week int, x int")
    out = {r.team: r.x_opponent for r in joins.partner_rows(df, "team", "opp", ["week"], ["x"]).collect()}
    assert out == {"a": 6, "b": 5, "c": None}


def test_pivot_takes_the_first_and_inverts(spark):
    df = spark.createDataFrame([("a", "x", 1, 9), ("a", "x", 2, 5), ("a", "y", 3, 4)], "k string, c string, t int, v int")
    wide = reshape.to_wide(df, ["k"], "c", ["x", "y"], ["v"], ["t"])
    assert tuple(wide.first()) == ("a", 9, 4)
    long = reshape.to_long(wide, ["k"], ["v_x", "v_y"], ["measure", "c"], "v")
    assert sorted((r.c, r.v) for r in long.collect()) == [("x", 9), ("y", 4)]


def test_name_split_drops_extra_pieces(spark):
    df = spark.createDataFrame([(1, 2)], "Male_5_to_9 int, Female_Under_5 int")
    out = reshape.to_long(df, [], df.columns, ["sex", "age"], "n").collect()
    assert sorted((r.sex, r.age, r.n) for r in out) == [("Female", "Under", 2), ("Male", "5", 1)]


def test_running_forms_agree_and_end_at_the_total(spark):
    rows = [(f"t{t}", w, (w * 7 + t) % 5 if (w + t) % 4 else None) for t in range(3) for w in range(1, 21)]
    df = spark.createDataFrame(rows, "team string, week int, x int")
    wide = windows.running_totals(df, ["team"], ["week"], {"cum_x": "x"})
    blocked = windows.running_totals_long(df, ["team"], ["week"], {"cum_x": "x"}, F.floor(F.col("week") / 6))
    unpivoted = windows.running_totals_unpivoted(df, ["team"], "week", ["x"])
    def as_map(d):
        return {(r.team, r.week): float(r.cum_x) for r in d.collect()}

    assert as_map(wide) == as_map(blocked) == as_map(unpivoted)
    last = {r.team: r.cum_x for r in wide.where("week = 20").collect()}
    assert last == {r.team: r.s for r in df.groupBy("team").agg(F.sum("x").alias("s")).collect()}


def test_lag_defaults(spark):
    df = spark.createDataFrame([("t", 1, 5.0), ("t", 2, None), ("t", 3, 7.0)], "t string, w int, x double")
    lags = windows.lagged(["t"], ["w"], {"a": ("x", 0.0), "b": ("x", None)})
    out = df.withColumns(lags).orderBy("w").collect()
    assert [r.a for r in out] == [0.0, 5.0, 0.0] and [r.b for r in out] == [None, 5.0, None]


def test_zscores_have_mean_zero_and_sd_one(spark):
    rows = [(w, float((w * p * 37) % 101)) for w in range(1, 12) for p in range(1, 11)]
    df = spark.createDataFrame(rows, "Week int, x double")
    stats = windows.group_zscores(df, ["Week"], {"z": "x"}).groupBy("Week").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in stats.collect())
    constant = spark.createDataFrame([(1, 2.0), (1, 2.0)], "Week int, x double")
    assert [r.z for r in windows.group_zscores(constant, ["Week"], {"z": "x"}).collect()] == [None, None]


def test_pruning(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, 4, None), (4, None, None)], "a int, b int, c string")
    assert pruning.prune_columns(df, 0.75).columns == ["a", "b", "c"]
    assert pruning.prune_columns(df, 0.75, inclusive=False).columns == ["a"]
    assert [r.a for r in pruning.prune_rows(df, 0.4).collect()] == [1, 3]
    assert pruning.complete_rows(df).count() == 0


def test_names_recode_align(spark):
    df = spark.createDataFrame([(1, "x")], "`A b` int, `a.b` string")
    assert columns.clean_names(df).columns == ["a_b", "a_b_2"]
    small = spark.createDataFrame([(5, "q")], "z int, extra string")
    like = spark.createDataFrame([(1, "t", 2)], "y int, t string, z int")
    assert tuple(columns.align_to(small, like).first()) == (0, "0", 5)
    got = spark.createDataFrame([("a",), ("b",), (None,)], "x string").select(columns.recode("x", {"a": "A"})).collect()
    assert [r[0] for r in got] == ["A", "b", None]


def test_union_and_split_together(spark):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([(2,)], "i int")
    train, test = sets.transform_together(a, b, lambda d: d.withColumn("n", F.col("i") * 10))
    assert [tuple(r) for r in train.collect()] == [(1, "x", 10)] and [tuple(r) for r in test.collect()] == [(2, None, 20)]


def test_floored_log(spark):
    df = spark.createDataFrame([(0.0,), (math.e,)], "v double")
    got = [r[0] for r in df.select(numeric.floored_log("v")).collect()]
    assert got == pytest.approx([math.log(0.1), 1.0])
