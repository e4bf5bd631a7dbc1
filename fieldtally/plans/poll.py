"""Weekly poll prediction from play-by-play rows.

plays -> games -> team-weeks -> dense calendar -> running totals -> opponent
weighting -> votes and lags -> vote weighting -> pruning, components, models, rank report.

The plays are read twice: for the wide sums per game, which map-side hash aggregation
shrinks before the shuffle, and for a narrow per-drive table.  Everything after is small
(teams x weeks).  The game, team-week and calendar tables are written to the shared folder,
so the joins of each with itself re-read small files, and only the columns they need.
Measures are generated from rules; a caller that names the columns it wants gets a plan
that computes only those and what they are made of.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_ratio, strict_sum
from ..functions.numeric import floored_log
from ..operators.joins import densify, having_members, left_attach, partner_rows
from ..operators.ranking import first_per_key
from ..operators.windows import lagged, running_sums
from ..session import store

# Play types, thresholds and periods: fixed values of the input data and of the report
PASS_COMPLETE = ("Pass Reception", "Passing Touchdown")
INTERCEPTED = ("Interception Return", "Interception Return Touchdown")
PASS_MISSED = ("Pass Incompletion", *INTERCEPTED)
RUSHED = ("Rush", "Rushing Touchdown")
FUMBLE_LOST = ("Fumble Recovery (Opponent)", "Fumble Recovery (Opponent) Touchdown")
PUNT_BLOCKED = ("Blocked Punt", "Blocked Punt Touchdown")
PUNTED = (*PUNT_BLOCKED, "Punt", "Punt Return Touchdown")
FG_BLOCKED = ("Blocked Field Goal", "Blocked Field Goal Touchdown")
FG_TRIED = (*FG_BLOCKED, "Field Goal Good", "Field Goal Missed", "Missed Field Goal Return", "Missed Field Goal Return Touchdown")
SCRIMMAGE = (
    *FUMBLE_LOST, "Fumble Recovery (Own)", "Fumble Return Touchdown", *INTERCEPTED, "Safety", "Rushing Touchdown", "Sack",
    "Rush", "Passing Touchdown", "Pass Reception", "Pass Incompletion",
)
YARD_THRESHOLDS = (5, 10, 15, 20, 25)
DOWNS = {1: "first", 2: "second", 3: "third", 4: "fourth"}
REDZONE_YARDS = 20
WEEKS = 15
VOTE_FLOOR = 0.1

KEYS = ["team", "year", "week"]
SEASON, ORDER = ["team", "year"], ["week"]


def _is(types: Sequence[str]) -> Column:
    return F.col("play_type").isin(list(types))


def play_measures() -> dict[str, Column]:
    """Additive measures of a set of plays, each one aggregate column."""
    yards = F.col("yards_gained")

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, yards)), F.lit(0.0)).cast("double")

    penalty = F.col("play_type") == "Penalty"
    out = {
        "passing_yards": total(_is(PASS_COMPLETE)),
        "rushing_yards": total(_is(RUSHED)),
        "passes_complete": F.count_if(_is(PASS_COMPLETE)),
        "passes_missed": F.count_if(_is(PASS_MISSED)),
        "passing_touchdowns": F.count_if(F.col("play_type") == "Passing Touchdown"),
        "rushes": F.count_if(_is(RUSHED)),
        "rushing_touchdowns": F.count_if(F.col("play_type") == "Rushing Touchdown"),
        "penalties_for": F.count_if(penalty & (yards > 0)),
        "penalties_against": F.count_if(penalty & (yards < 0)),
        "penalty_yards_for": total(penalty & (yards > 0)),
        "penalty_yards_against": -total(penalty & (yards < 0)),
        "sacks": F.count_if(F.col("play_type") == "Sack"),
        "interceptions": F.count_if(_is(INTERCEPTED)),
        "fumbles": F.count_if(_is(FUMBLE_LOST)),
        "punts_blocked": F.count_if(_is(PUNT_BLOCKED)),
        "punts": F.count_if(_is(PUNTED)),
        "fg_blocked": F.count_if(_is(FG_BLOCKED)),
        "fg_attempts": F.count_if(_is(FG_TRIED)),
        "fg_good": F.count_if(F.col("play_type") == "Field Goal Good"),
    }
    for t in YARD_THRESHOLDS:
        for name, types in (("plays", PASS_COMPLETE + RUSHED), ("passing_plays", PASS_COMPLETE), ("rushing_plays", RUSHED)):
            out[f"{name}_over_{t}"] = F.count_if(_is(types) & (yards >= t))
    for value, name in DOWNS.items():
        tried = _is(SCRIMMAGE) & (F.col("down") == value)
        out[f"{name}_downs"] = F.count_if(tried)
        out[f"{name}_downs_converted"] = F.count_if(tried & (F.col("success") == 1))
    return out


# Derived measures: sums of measures, then ratios of measures
COMBINED = {
    "yards": ("passing_yards", "rushing_yards"),
    "pass_attempts": ("passes_complete", "passes_missed"),
    "plays": ("passes_complete", "passes_missed", "rushes"),
    "turnovers": ("interceptions", "fumbles"),
}
COMBINED_OFFENCE = {
    "scoring_plays": ("fg_good", "passing_touchdowns", "rushing_touchdowns"),
    "redzone_scores": ("redzone_touchdowns", "redzone_fgs"),
}
RATIOS = {
    "completion_rate": ("passes_complete", "pass_attempts"),
    "yards_per_pass": ("passing_yards", "pass_attempts"),
    "yards_per_rush": ("rushing_yards", "rushes"),
    "yards_per_play": ("yards", "plays"),
    **{f"{d}_down_rate": (f"{d}_downs_converted", f"{d}_downs") for d in DOWNS.values()},
}
RATIOS_OFFENCE = {
    "yards_per_completion": ("passing_yards", "passes_complete"),
    "fg_rate": ("fg_good", "fg_attempts"),
    "redzone_touchdown_rate": ("redzone_touchdowns", "redzone_drives"),
    "redzone_fg_rate": ("redzone_fgs", "redzone_drives"),
    "redzone_scoring_rate": ("redzone_scores", "redzone_drives"),
    "minutes_per_possession": ("possession_minutes", "possessions"),
    "minutes_per_play": ("possession_minutes", "plays"),
}
FORCED = ("sacks", "interceptions", "fumbles", "turnovers")
REDZONE = ("redzone_drives", "redzone_touchdowns", "redzone_fgs")
OFFENCE_ONLY = (
    "penalties_for", "penalties_against", "penalty_yards_for", "penalty_yards_against", "punts_blocked", "punts",
    "fg_blocked", "fg_attempts", "fg_good",
)
RESULTS = ("points", "points_allowed", "margin", "win", "loss")


def _with_sums(df: DataFrame, parts: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add the sums whose parts are all there."""
    have = set(df.columns)
    return df.withColumns({n: sum((F.col(c) for c in p[1:]), F.col(p[0])) for n, p in parts.items() if have.issuperset(p)})


def _with_ratios(df: DataFrame, pairs: Mapping[str, tuple[str, str]], prefix: str = "") -> DataFrame:
    have = set(df.columns)
    found = {n: (f"{prefix}{a}", f"{prefix}{b}") for n, (a, b) in pairs.items()}
    return df.withColumns({f"{prefix}{n}": safe_ratio(*p) for n, p in found.items() if have.issuperset(p)})


GAME = ["team", "year", "week", "game_id"]


def needed_for(columns: Sequence[str]) -> set[str]:
    """The wanted columns and everything they are made of, by the naming rules."""
    parts = {**COMBINED, **COMBINED_OFFENCE, **RATIOS, **RATIOS_OFFENCE}
    todo, found = list(columns), set()
    while todo:
        name = todo.pop()
        if name in found:
            continue
        found.add(name)
        for side in ("", "allowed_", "forced_", "cum_", "cum_allowed_", "cum_forced_"):
            if name.startswith(side) and name[len(side):] in parts:
                todo += [side.replace("forced_", "") + p for p in parts[name[len(side):]]]
        for prefix in ("cum_", "w_", "v_", "m_", "lag_", "allowed_", "forced_"):
            if name.startswith(prefix):
                todo.append(name[len(prefix):])
        for suffix in ("_per_game", "_opponent"):
            if name.endswith(suffix):
                todo += [name[: -len(suffix)], "games"]
        if name.startswith("w_") or name in ("adjusted_win_rate", "cum_win_rate"):
            todo += ["cum_win_rate", "cum_win", "win"]
        if name.startswith("m_"):
            todo += [MATCHUPS.get(name[2:], "cum_scoring_plays")]
        if name == "cum_margin_product":
            todo.append("cum_margin")
    return found


def _only(exprs: Mapping[str, Column], needed: set[str] | None) -> dict[str, Column]:
    return {n: c for n, c in exprs.items() if needed is None or n in needed}


def game_measures(plays: DataFrame, needed: set[str] | None = None) -> DataFrame:
    """Additive measures per game and pair of teams.

    Only numbers are aggregated here, so map-side hash aggregation shrinks the plays to one
    wide row per game before anything is shuffled.
    """
    opened = F.col("drive_numbers") == 1
    clock = F.col("drive_time_minutes_elapsed") * 60 + F.col("drive_time_seconds_elapsed")
    return plays.groupBy("pos_team", "def_pos_team", "year", "week", "game_id").agg(
        *[c.alias(n) for n, c in _only(play_measures(), needed).items()],
        strict_sum(opened.cast("int")).alias("possessions"),
        strict_sum(F.when(opened, clock).when(~opened, F.lit(0))).alias("__seconds"),
    )


def drive_flags(plays: DataFrame, order: Sequence[str] = ("game_play_number",)) -> DataFrame:
    """Per drive: red-zone flags, the last play's score and opponent, the conference.  Narrow,
    and keyed by drive, so distinct drives are counted without gathering a team's plays."""
    near = F.col("yards_to_goal") <= REDZONE_YARDS
    touchdown = F.col("play_type").isin("Passing Touchdown", "Rushing Touchdown")
    conditions = dict(zip(REDZONE, (near, near & touchdown, near & (F.col("play_type") == "Field Goal Good"))))
    aggs = []
    for name, cond in conditions.items():
        aggs.append(F.max(F.when(cond, 1).otherwise(0)).alias(name))
        aggs.append(F.max(F.when(cond.isNull(), 1).otherwise(0)).alias(f"__null_{name}"))
    aggs += [
        F.max(F.struct(*order, F.col("def_pos_team").alias("__opponent"), "pos_team_score", "def_pos_team_score")).alias("__last"),
        F.max(F.when(F.col("offense_play") == F.col("pos_team"), F.col("offense_conference"))).alias("conference"),
    ]
    return plays.groupBy(F.col("pos_team").alias("team"), *GAME[1:], "drive_number").agg(*aggs)


def _first_games(games: DataFrame) -> DataFrame:
    """Only the first game of a team's week."""
    return first_per_key(games, KEYS, ["game_id"])


def offence_weeks(games: DataFrame, drives: DataFrame, count_null: bool = True) -> DataFrame:
    """One row per team and week with its own measures.

    ``count_null``: a drive whose red-zone condition is unknown counts as one more drive.
    """
    own = games.groupBy(F.col("pos_team").alias("team"), *GAME[1:]).agg(
        *[F.sum(m).alias(m) for m in play_measures() if m in games.columns],
        strict_sum("possessions").alias("possessions"),
        (strict_sum("__seconds") / 60).alias("possession_minutes"),
    )
    aggs = []
    for name in REDZONE:
        known = F.sum(F.when(F.col("drive_number").isNotNull(), F.col(name)).otherwise(0))
        unknown = F.max(F.greatest(F.col(f"__null_{name}"), F.when(F.col("drive_number").isNull(), F.col(name)).otherwise(0)))
        aggs.append(((known + unknown) if count_null else known).cast("long").alias(name))
    per_game = drives.groupBy(*GAME).agg(*aggs, F.max("__last").alias("__last"), F.max("conference").alias("conference"))
    rows = _first_games(own).join(per_game, GAME, "left").drop("game_id")
    results = {
        "opponent": F.col("__last.__opponent"),
        "points": F.col("__last.pos_team_score"),
        "points_allowed": F.col("__last.def_pos_team_score"),
        "margin": F.col("__last.pos_team_score") - F.col("__last.def_pos_team_score"),
        "win": (F.col("__last.pos_team_score") > F.col("__last.def_pos_team_score")).cast("int"),
        "loss": (F.col("__last.pos_team_score") <= F.col("__last.def_pos_team_score")).cast("int"),
    }
    combined = _with_sums(rows.withColumns(results), {**COMBINED, **COMBINED_OFFENCE}).drop("__last")
    return _with_ratios(combined, {**RATIOS, **RATIOS_OFFENCE})


def defence_measures() -> list[str]:
    """What opponents did, renamed ``allowed_`` (and ``forced_`` for their mishaps)."""
    skip = set(OFFENCE_ONLY) | set(FORCED)
    return [m for m in play_measures() if m not in skip] + [c for c in COMBINED if c not in skip]


def defence_weeks(games: DataFrame) -> DataFrame:
    used = [m for m in play_measures() if m not in OFFENCE_ONLY and m in games.columns]
    faced = games.groupBy(F.col("def_pos_team").alias("team"), *GAME[1:]).agg(*[F.sum(m).alias(m) for m in used])
    rows = _with_ratios(_with_sums(_first_games(faced), COMBINED), RATIOS)
    have = set(rows.columns)
    allowed = [m for m in (*defence_measures(), *RATIOS) if m in have]
    forced = [m for m in FORCED if m in have]
    return rows.select(*KEYS, *[F.col(m).alias(f"allowed_{m}") for m in allowed], *[F.col(m).alias(f"forced_{m}") for m in forced])


def season_calendar(
    plays: DataFrame, order: Sequence[str] = ("game_play_number",), weeks: int = WEEKS, count_null: bool = True,
    needed: set[str] | None = None,
) -> DataFrame:
    """Team-weeks with both sides' measures on a dense calendar; wins and losses zero-filled."""
    games = store(game_measures(plays, needed), "games")
    offence = offence_weeks(games, drive_flags(plays, order), count_null)
    # the grid and the facts both come from it
    both = store(left_attach(offence, defence_weeks(games), KEYS), "weeks")
    return densify(both, ["team", "year", "conference"], "week", 1, weeks, zero_fill=["win", "loss"], null_safe=["conference"])


def own_measures() -> list[str]:
    return [*play_measures(), *COMBINED, *COMBINED_OFFENCE, *REDZONE, "possessions", "possession_minutes"]


def additive_measures() -> list[str]:
    return [
        *RESULTS, *own_measures(), *[f"allowed_{m}" for m in defence_measures()], *[f"forced_{m}" for m in FORCED]
    ]


def _all_ratios() -> dict[str, tuple[str, str]]:
    allowed = {f"allowed_{n}": (f"allowed_{a}", f"allowed_{b}") for n, (a, b) in RATIOS.items()}
    return {**RATIOS, **RATIOS_OFFENCE, **allowed}


def with_running_totals(calendar: DataFrame, needed: set[str] | None = None) -> DataFrame:
    """Running sums of every measure, ratios of running sums, and both per game played."""
    have = set(calendar.columns)
    measures = [m for m in additive_measures() if m in have and (needed is None or f"cum_{m}" in needed)]
    sums = running_sums(SEASON, ORDER, {f"cum_{m}": m for m in measures})
    games = running_sums(SEASON, ORDER, {"games": F.col("opponent").isNotNull().cast("int")})
    rated = _with_ratios(calendar.withColumns({**sums, **games}), _all_ratios(), "cum_")
    if "cum_win" in rated.columns:
        rated = rated.withColumn("cum_win_rate", safe_ratio("cum_win", "games"))
    averages = [c for c in rated.columns if c.startswith("cum_") and c not in ("cum_win", "cum_loss", "cum_win_rate")]
    return rated.withColumns(_only({f"{c}_per_game": safe_ratio(c, "games") for c in averages}, needed))


# Own measure x what the opponent usually allows or produces. Fixed values of the published features:
# some pairs deliberately meet an unlike measure.
MATCHUPS = {
    "points": "cum_points_allowed_per_game",
    "yards": "cum_allowed_yards_per_game",
    "passing_yards": "cum_allowed_passing_yards_per_game",
    "rushing_yards": "cum_allowed_rushing_yards_per_game",
    "pass_attempts": "cum_allowed_passes_complete_per_game",
    "passes_complete": "cum_allowed_passes_complete_per_game",
    "passing_touchdowns": "cum_allowed_passing_touchdowns_per_game",
    "rushes": "cum_allowed_rushes_per_game",
    "rushing_touchdowns": "cum_allowed_rushing_touchdowns_per_game",
    "first_down_rate": "cum_allowed_first_down_rate_per_game",
    "second_down_rate": "cum_allowed_second_down_rate_per_game",
    "third_down_rate": "cum_allowed_third_down_rate_per_game",
    "points_allowed": "cum_points_per_game",
    "allowed_passing_yards": "cum_passing_yards_per_game",
    "allowed_rushing_yards": "cum_rushing_yards_per_game",
    "allowed_yards": "cum_yards_per_game",
    "allowed_passes_complete": "cum_completion_rate",
    "allowed_pass_attempts": "cum_pass_attempts_per_game",
    "allowed_passing_touchdowns": "cum_passing_touchdowns_per_game",
    "allowed_rushes": "cum_rushes_per_game",
    "allowed_rushing_touchdowns": "cum_rushing_touchdowns_per_game",
}
OPPONENT_RESULTS = ("win", "points", "scoring_plays", "yards")
RUNNING_WEIGHTED = ("win", "loss", "points", "points_allowed", "yards", "scoring_plays", "yards_per_play", "allowed_yards")


def with_opponent_weights(rated: DataFrame, needed: set[str] | None = None) -> DataFrame:
    """Measures weighted by the opponent's running win rate, match-up products, and their
    running totals and per-game averages."""
    have = set(rated.columns)
    theirs = sorted({"cum_win_rate", "cum_margin", *MATCHUPS.values(), *OPPONENT_RESULTS} & have)
    both = partner_rows(rated, "team", "opponent", ["year", "week"], theirs)
    strength = F.col("cum_win_rate_opponent")
    skip = {*KEYS, "opponent", "conference", "games"}
    weighted = {f"w_{c}": F.col(c) * strength for c in rated.columns if c not in skip}
    for flag in ("win", "loss"):
        weighted[f"w_{flag}"] = F.coalesce(F.col(flag) * strength, F.lit(0.0))
    weighted |= {f"w_{c}_opponent": F.col(f"{c}_opponent") * strength for c in OPPONENT_RESULTS if c in have}
    weighted |= {f"m_{own}": F.col(own) * F.col(f"{t}_opponent") for own, t in MATCHUPS.items() if {own, t} <= have}
    if {"allowed_plays", "cum_scoring_plays"} <= have:
        weighted["m_allowed_plays"] = F.col("allowed_plays") * F.col("cum_scoring_plays")
    if "cum_margin" in have:
        weighted["cum_margin_product"] = F.col("cum_margin") * F.col("cum_margin_opponent")
    if "cum_win_rate" in have:
        weighted["adjusted_win_rate"] = safe_ratio(F.col("cum_win") - F.col("cum_win_rate") * strength, "games")
    weighted = _only(weighted, needed)
    out = both.withColumns(weighted).drop(*[f"{c}_opponent" for c in theirs])
    running = [f"w_{c}" for c in RUNNING_WEIGHTED] + [f"w_{c}_opponent" for c in OPPONENT_RESULTS]
    running += [f"m_{c}" for c in MATCHUPS] + ["m_allowed_plays"]
    running = [c for c in running if c in weighted and (needed is None or f"cum_{c}" in needed)]
    summed = out.withColumns(running_sums(SEASON, ORDER, {f"cum_{c}": c for c in running}))
    return summed.withColumns(_only({f"cum_{c}_per_game": safe_ratio(f"cum_{c}", "games") for c in running}, needed))


def poll_rows(calendar: DataFrame) -> DataFrame:
    """The calendar's votes: zeros lifted to the floor, logs, lags, the opponent's lag.

    Conferences that never got a vote are dropped before the opponent's lag is looked up.
    Narrow on purpose: it is joined back to the wide features by key.
    """
    base = calendar.select(*KEYS, "opponent", "conference", "votes")
    filled = base.withColumn("votes", F.coalesce(F.col("votes").cast("double"), F.lit(0.0)))
    voted = having_members(filled, ["conference"], F.col("__all_votes") > VOTE_FLOOR, F.sum("votes").alias("__all_votes"))
    logged = voted.withColumns(
        {"analytical_votes": F.when(F.col("votes") == 0, F.lit(VOTE_FLOOR)).otherwise(F.col("votes")), "log_votes": floored_log("votes", VOTE_FLOOR)}
    )
    lags = lagged(
        SEASON, ORDER,
        {
            "lag_votes": ("votes", 0.0),
            "lag_analytical_votes": ("analytical_votes", VOTE_FLOOR),
            "lag_log_votes": ("log_votes", math.log(VOTE_FLOOR)),
        },
    )
    return partner_rows(logged.withColumns(lags), "team", "opponent", ["year", "week"], ["lag_log_votes"]).drop("opponent", "conference")


# Measures weighted by the opponent's last vote: fixed values of the published features
VOTE_WEIGHTED = (
    *RESULTS, "passing_yards", "rushing_yards", "yards", "passes_complete", "yards_per_pass", "passing_touchdowns",
    "yards_per_rush", "rushing_touchdowns", "plays", "yards_per_play", "redzone_scoring_rate", "fourth_down_rate",
    "allowed_passing_yards", "allowed_rushing_yards", "allowed_yards", "allowed_passes_complete",
    "allowed_passing_touchdowns", "allowed_rushes", "allowed_rushing_touchdowns", "allowed_fourth_down_rate",
)
LAGGED_FLAGS = ("win", "loss", "w_win", "w_loss", "v_win", "v_loss")


def with_vote_weights(weighted: DataFrame, polled: DataFrame, zero_fill_win: bool = True, needed: set[str] | None = None) -> DataFrame:
    """Measures weighted by the opponent's last vote, their running totals, lagged results.

    ``zero_fill_win=False`` leaves the first week's lagged win missing.
    """
    both = weighted.join(polled, KEYS, "inner")
    rate = F.col("lag_log_votes_opponent")
    have = set(weighted.columns)
    measures = {f"v_{m}": F.col(m) * rate for m in VOTE_WEIGHTED if m in have}
    for flag in ("win", "loss"):
        measures[f"v_{flag}"] = F.coalesce(measures[f"v_{flag}"], F.lit(0.0))
    measures = _only(measures, needed)
    totals = [c for c in measures if needed is None or f"cum_{c}" in needed]
    voted = both.withColumns(measures).withColumns(running_sums(SEASON, ORDER, {f"cum_{c}": c for c in totals}))
    per_game = _only({f"cum_{c}_per_game": safe_ratio(f"cum_{c}", "games") for c in totals}, needed)
    flags = [f for f in LAGGED_FLAGS if f in voted.columns]
    defaults = {f"lag_{f}": (f, 0.0 if zero_fill_win or f != "win" else None) for f in flags}
    return voted.withColumns({**per_game, **lagged(SEASON, ORDER, defaults)})


def season_features(
    plays: DataFrame, votes: DataFrame, order: Sequence[str] = ("game_play_number",), weeks: int = WEEKS,
    count_null: bool = True, zero_fill_win: bool = True, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Play-by-play and poll votes to one feature row per team and week.

    ``columns`` names the wanted ones; without it all some nine hundred are built.
    """
    needed = None if columns is None else needed_for(columns) | set(RESULTS)
    played = season_calendar(plays, order, weeks, count_null, needed)
    calendar = store(left_attach(played, votes.select(*KEYS, "votes"), KEYS), "calendar")
    weighted = with_opponent_weights(with_running_totals(calendar.drop("votes"), needed), needed)
    out = with_vote_weights(weighted, poll_rows(calendar), zero_fill_win, needed)
    return out if columns is None else out.select(*columns)


# The model's input besides the component scores: fixed values of the published features
MODEL_COLUMNS = (
    "lag_log_votes", "cum_win", "cum_loss", "cum_m_allowed_passes_complete_per_game", "cum_allowed_completion_rate",
    "cum_allowed_passes_missed", "cum_allowed_yards_per_pass_per_game", "cum_m_allowed_passing_yards_per_game",
    "cum_allowed_passing_touchdowns_per_game", "cum_allowed_yards_per_play", "cum_fourth_down_rate_per_game",
    "cum_w_win_per_game", "cum_w_win", "cum_m_points", "cum_w_loss", "cum_w_win_opponent", "cum_w_points_allowed_per_game",
    "cum_redzone_scoring_rate", "cum_win_rate", "cum_v_allowed_yards", "cum_v_loss", "cum_v_yards", "cum_v_margin_per_game",
    "cum_margin", "cum_margin_per_game", "cum_v_margin", "cum_v_loss_per_game",
    *[f"lag_{f}" for f in LAGGED_FLAGS],
)
TARGET = "log_votes"
IDENTITY = (*KEYS, "conference", "opponent", "votes", "analytical_votes", "log_votes", "lag_votes", "lag_analytical_votes", "lag_log_votes")

