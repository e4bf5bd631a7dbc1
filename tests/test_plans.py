"""The recipes on small tables in the shape of their inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.plans import cards, dots, league, listening, poll, pyramid, report, tabular, votes
from fieldtally.session import scratch_path
from fieldtally.sources import files


def test_listening_from_json(spark):
    raw = spark.createDataFrame(
        [
            ("2020-01-01T10:00:00Z", 60000, "s1", "A", "al", None), ("2020-01-01T10:00:00Z", 60000, "s0", "A", "al", None),
            ("2020-01-08T10:00:00Z", 120000, "s2", "B", "bl", None), ("2020-02-01T00:00:00Z", 30000, None, None, None, "cast"),
            ("2020-02-01T01:00:00Z", 30000, None, None, None, None), ("2020-02-02T01:00:00Z", 30000, "n", "Pink Noise", "x", None),
            ("2013-02-02T01:00:00Z", 30000, "n", "C", "x", None), ("2020-02-03T01:00:00Z", 0, "z", "C", "x", None),
            ("2025-02-03T01:00:00Z", 10, "z", "C", "x", None),
        ],
        "ts string, ms_played long, track string, artist string, album string, show string",
    ).select(
        "ts", "ms_played", F.struct(F.col("track").alias("track_name"), F.col("artist").alias("album_artist_name"), F.col("album").alias("album_album_name")).alias("master_metadata"),
        F.lit("x").alias("reason_start"), F.lit("y").alias("reason_end"), F.lit(False).alias("shuffle"), F.lit(False).alias("skipped"),
        F.col("show").alias("episode_show_name"),
    )
    path = files.write_json(raw, scratch_path(spark, "listening"))
    flat = files.read_json(spark, path, raw.schema, multi_line=False)
    assert "master_metadata_track_name" in flat.columns
    rows = listening.analysis_rows(listening.clean_history(flat), "2025-03-01")
    got = sorted((r.ts, r.track_name, r.type, r.week) for r in rows.select("ts", F.coalesce("track_name", F.lit("-")).alias("track_name"), "type", "week").collect())
    assert got == [
        ("2020-01-01T10:00:00Z", "s0", "song", 1), ("2020-01-08T10:00:00Z", "s2", "song", 2),
        ("2020-02-01T00:00:00Z", "-", "show/podcast/book", 5),
    ]
    assert [(r.artist, r.minutes) for r in listening.leaders(rows, ["artist"], 1).collect()] == [("B", 2.0)]
    run = listening.cumulative_leaders(rows, "artist", 2).orderBy("artist").collect()
    assert [(r.artist, r.total_hours) for r in run] == [("A", 60 / 3600), ("B", 120 / 3600)]
    assert listening.labelled_leaders(rows, "album", 1).first().label == "bl, B"
    assert listening.variety(rows, "artist").first().distinct_count == 2


def test_votes_to_map(spark):
    rows = [
        (2020, "WISCONSIN", "DANE", "DEMOCRAT", "TOTAL", 260, 340), (2020, "WISCONSIN", "DANE", "REPUBLICAN", "TOTAL", 78, 340),
        (2020, "WISCONSIN", "DANE", "DEMOCRAT", "MAIL", 1, 340), (2016, "WISCONSIN", "DANE", "DEMOCRAT", "TOTAL", 1, 1),
        (2020, "IOWA", "LEE", "DEMOCRAT", "MAIL", 20, 100), (2020, "IOWA", "LEE", "DEMOCRAT", "DAY", 15, 100),
        (2020, "IOWA", "LEE", "REPUBLICAN", "DAY", 60, 100), (2020, "ALASKA", "D1", "DEMOCRAT", "TOTAL", 6, 10),
        (2020, "IOWA", "SAINT LOUIS", "DEMOCRAT", "DAY", 6, 10), (2020, "IOWA", "SAINT LOUIS", "GREEN", "DAY", 3, 10),
    ]
    returns = spark.createDataFrame(rows, "year int, state string, county_name string, party string, mode string, candidatevotes long, totalvotes long")
    shapes = spark.createDataFrame([("Dane County, Wisconsin",), ("Lee County, Iowa",), ("St. Louis County, Iowa",)], "NAME string")
    out = {r.county_name: r for r in votes.vote_map(returns, votes.split_place(shapes), 2020).collect()}
    assert set(out) == {"DANE", "LEE", "ST. LOUIS"}
    assert (out["DANE"].Democrat, out["DANE"].Republican, out["DANE"]["diff"]) == (0.765, 0.229, 0.765)
    assert out["DANE"].map_class == "75% to 85% Democrat"
    assert round(out["LEE"]["diff"], 6) == 0.4 and out["LEE"].map_class == "55% to 65% Republican"
    assert out["ST. LOUIS"]["diff"] is None
    labels = votes.map_labels()
    assert len(labels) == 11 and labels[0] == "95%+ Republican" and labels[6] == "55% to 65% Democrat" and labels[-1] == "95%+ Democrat"


def test_cards(spark):
    deck = spark.createDataFrame(
        [
            ("Bear", "s1", "Creature - Bear", "normal", "2", "2", "['G']", "text", 2.0), ("Bear", "s2", "Creature - Bear", "normal", "2", "2", "['G']", "text", 2.0),
            ("Star", "s1", "Creature", "normal", "*", "1", "['W']", "abc", 1.0), ("A-Bear", "s1", "Creature", "normal", "1", "1", "['G']", "abc", 1.0),
            ("Duo", "s2", "Creature", "normal", "4", "1", "['G', 'W']", "abcd", 3.0), ("Lost", "s9", "Creature", "normal", "4", "1", "['G']", "abcd", 3.0),
            ("Joke", "Unglued", "Creature", "normal", "4", "1", "['G']", "abcd", 3.0), ("Spell", "s1", "Instant", "normal", None, None, "['G']", "abcd", 3.0),
        ],
        "name string, set string, type string, layout string, power string, toughness string, color_identity string, text string, cmc double",
    )
    years = spark.createDataFrame([("s1", 2011), ("s2", 2012), ("Unglued", 2011)], "set_name string, release_year int")
    first = cards.first_printings(deck, years)
    assert sorted((r.name, r.release_year, r.power) for r in first.collect()) == [("Bear", 2011, 2.0), ("Duo", 2012, 4.0)]
    assert [(r.release_year, r.strength_per_cost) for r in cards.trends(first).orderBy("release_year").collect()] == [(2011, 2.0), (2012, 1.666667)]
    assert [r.colour for r in cards.with_colour(first).collect()] == ["Green"]


def test_pyramid_and_dots(spark):
    columns = pyramid.age_columns()
    assert len(columns) == 46
    wide = spark.createDataFrame([tuple(range(46)), tuple([1] * 46)], ", ".join(f"`{c}` long" for c in columns))
    out = {(r.Gender, r.Age_Group): (r.Count, r.sort_key) for r in pyramid.pyramid(wide).collect()}
    assert len(out) == 36 and out["Male", "15 to 19"] == (-(3 + 4 + 2), 4) and out["Female", "Under 5"] == (24, 1)
    long = spark.createDataFrame([("g1", code, 10 * i) for i, code in enumerate(dots.CENSUS_CODES)], "GEOID string, variable string, value long")
    counts = dots.group_counts(long).first()
    assert counts.Total_Other == 50 + 60 + 70 + 80
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    shapes = spark.createDataFrame([("g1", ring)], "GEOID string, ring array<struct<x:double,y:double>>")
    drawn = dots.population_dots(dots.group_counts(long).join(shapes, "GEOID")).groupBy("population_group").count()
    assert {r.population_group: r["count"] for r in drawn.collect()} == {"Tot_White": 2, "Tot_Black": 4, "Tot_Asian": 6, "Tot_HispLat": 8, "Total_Other": 52}


def test_league(spark):
    rows = [(w, p, 100.0 * w + p * w, 90.0 * w + p) for w in (1, 2, 3) for p in range(10)]
    df = spark.createDataFrame(rows, "Week int, Person int, Points_For double, Points_Against double")
    z = league.standard_scores(df).groupBy("Week").agg(F.avg("std_points_for").alias("m"), F.stddev_samp("std_points_for").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in z)
    assert {r.Points_For for r in league.weekly_scores(df).where("Person = 3").collect()} == {103.0}


def test_report(spark):
    df = spark.createDataFrame([("a", 10.0, 5.0), ("b", 9.0, 9.0), ("c", 9.0, 1.0), ("d", 1.0, 0.0)], "team string, predicted double, actual double")
    out = {r.team: r for r in report.compare_ranks(df, ["team"], "predicted", "actual", cut=3).collect()}
    assert (out["a"].predicted_rank, out["a"].actual_rank, out["a"].rank_difference, out["a"].colour) == (1.0, 2.0, 1.0, "green")
    assert (out["b"].predicted_rank, out["b"].colour) == (2.5, "red") and "d" not in out
    shown = report.styled(report.compare_ranks(df, ["team"], "predicted", "actual"), "team").collect()
    assert [r["Predicted Rank"] for r in shown] == ["1", "2", "2", "4"]


def test_tabular(spark):
    train = spark.createDataFrame(
        [(1, 1.0, "x y", 1, 5), (2, None, None, 0, 6), (3, 3.0, "z", 1, 7)], "id int, n double, t string, label int, only_train int"
    )
    test = spark.createDataFrame([(4, None, "w")], "id int, n double, t string")
    a, b, features = tabular.prepare_classification(train, test, "id", "label", {"t": {"z": "x y"}})
    assert features == ["n", "t_w", "t_x_y"]
    assert [tuple(r) for r in a.orderBy("id").select("n", "t_w", "t_x_y").collect()] == [(-1.224744871391589, 0, 1), (0.0, 0, 0), (1.224744871391589, 0, 1)]
    assert tuple(b.select("n", "t_w", "t_x_y").first()) == (0.0, 1, 0)


def test_survey(spark):
    rows = [(f"i{i}", float(i), float(i * i), None if i % 2 else "Fall", None if i else 1.0, i % 2) for i in range(10)]
    train = spark.createDataFrame(rows, "id string, `BIA-a` double, `BIA-b` double, Season string, sparse double, sii int")
    test = train.drop("sii")
    a, b = tabular.prepare_survey(train, test, "sii", left_out=["id"], components={"bia": 1})
    assert a.columns == ["sii", "bia_PC1"] and b.columns == ["bia_PC1"] and a.count() == b.count() == 10


def pbp(spark):
    def play(team, opp, week, game, number, kind, yards, down=1, success=1, drive=1, goal=50, score=0, other=0, first=0):
        return (team, opp, "East", team, 2024, week, game, number, kind, yards, down, success, drive, first, goal, float(score), float(other), 1.0, 30.0)

    rows = [
        play("A", "B", 1, 10, 1, "Pass Reception", 12.0, first=1), play("A", "B", 1, 10, 2, "Rush", 5.0, down=2, success=0, goal=15),
        play("A", "B", 1, 10, 3, "Passing Touchdown", 20.0, down=1, drive=1, goal=20, score=7), play("A", "B", 1, 10, 9, "Field Goal Good", 0.0, drive=2, goal=18, score=10, other=3, first=1),
        play("B", "A", 1, 10, 4, "Interception Return", 3.0, first=1), play("B", "A", 1, 10, 5, "Sack", -7.0, down=3, success=0, score=3, other=7),
        play("A", "B", 1, 11, 1, "Rush", 99.0, score=50), play("B", "A", 1, 11, 1, "Rush", 99.0, score=50),
        play("A", "B", 3, 12, 1, "Penalty", -10.0, score=1, other=2), play("B", "A", 3, 12, 2, "Penalty", 5.0, score=2, other=1, goal=None),
    ]
    return spark.createDataFrame(
        rows,
        "pos_team string, def_pos_team string, offense_conference string, offense_play string, year int, week int, game_id long, game_play_number int, play_type string, "
        "yards_gained double, down int, success int, drive_number int, drive_numbers int, yards_to_goal int, pos_team_score double, def_pos_team_score double, "
        "drive_time_minutes_elapsed double, drive_time_seconds_elapsed double",
    )


def test_poll_features(spark):
    ballots = spark.createDataFrame([("A", 2024, 1, 100)], "team string, year int, week int, votes long")
    full = poll.season_features(pbp(spark), ballots, weeks=3).orderBy("team", "week").collect()
    assert len(full) == 6
    a1, a2, a3, b1, _, b3 = full
    assert (a1.opponent, a1.points, a1.points_allowed, a1.win, a1.loss) == ("B", 10.0, 3.0, 1, 0)
    assert (a1.passing_yards, a1.rushing_yards, a1.yards, a1.plays, a1.plays_over_10, a1.plays_over_5) == (32.0, 5.0, 37.0, 3, 2, 3)
    assert (a1.redzone_drives, a1.redzone_touchdowns, a1.redzone_fgs, a1.scoring_plays) == (2, 1, 1, 2)
    assert (a1.possessions, a1.possession_minutes, a1.first_down_rate, a1.second_down_rate) == (2, 3.0, 1.0, 0.0)
    assert (a1.allowed_passes_missed, a1.forced_interceptions, a1.forced_sacks, a1.forced_turnovers) == (1, 1, 1, 1)
    assert (a2.opponent, a2.win, a2.loss, a2.games, a2.cum_win, a2.cum_win_rate) == (None, 0, 0, 1, 1, 1.0)
    assert (a3.penalties_against, a3.penalty_yards_against, a3.games, a3.cum_win_rate, a3.cum_points_per_game) == (1, 10.0, 2, 0.5, 5.5)
    assert (b1.interceptions, b1.sacks, b1.third_downs, b1.allowed_yards) == (1, 1, 1, 37.0)
    # a missing distance to the goal counts as one more red-zone drive
    assert b3.redzone_drives == 1
    # opponent strength: B's running rate in week 3 is one win in two games
    assert (a1.w_win, a3.w_loss, b3.w_win) == (0.0, 0.5, 0.5)
    # B allowed 7 by its own last play; margins so far are 6 and -3
    assert (a1.m_points, a1.cum_m_points, a3.cum_margin_product) == (70.0, 70.0, -18.0)
    # only A has votes, in week 1; the floor's log elsewhere
    assert (round(a1.log_votes, 6), round(a2.lag_log_votes, 6), round(a1.lag_log_votes, 6)) == (4.60517, 4.60517, -2.302585)
    assert round(b3.v_points, 6) == round(2.0 * -2.302585093, 6)
    assert (a1.lag_win, a2.lag_win, a3.lag_win) == (0.0, 1.0, 0.0)


def test_wanted_columns_equal_the_full_table(spark):
    ballots = spark.createDataFrame([("A", 2024, 1, 100)], "team string, year int, week int, votes long")
    wanted = [*poll.KEYS, *poll.MODEL_COLUMNS]
    few = poll.season_features(pbp(spark), ballots, weeks=3, columns=wanted)
    full = poll.season_features(pbp(spark), ballots, weeks=3).select(*wanted)
    assert few.orderBy(*poll.KEYS).collect() == full.orderBy(*poll.KEYS).collect()
