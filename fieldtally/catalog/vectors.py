"""All generated season features, row by row in long form, against SQL that never builds them as columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import poll, poll_vectors
from .recipes import _PBP_SQL, _POLL_SQL, play_by_play, poll_votes
from .registry import query
from .tables import PLAY_ORDER

# The measures once more, written down for SQL: the play types that occur in the given tables
_CAUGHT = "play_type IN ('Pass Reception', 'Passing Touchdown')"
_RAN = "play_type IN ('Rush', 'Rushing Touchdown')"
_MISSED = "play_type IN ('Pass Incompletion', 'Interception Return')"
_TRIED = (
    "play_type IN ('Pass Reception', 'Passing Touchdown', 'Pass Incompletion', 'Rush', 'Rushing Touchdown', 'Sack', 'Interception Return',"
    " 'Fumble Recovery (Opponent)')"
)


def _measures_sql() -> dict[str, str]:
    yards = lambda cond: f"coalesce(sum(yards_gained) FILTER (WHERE {cond}), 0)"
    plays = lambda cond: f"count(*) FILTER (WHERE {cond})"
    out = {
        "passing_yards": yards(_CAUGHT), "rushing_yards": yards(_RAN), "passes_complete": plays(_CAUGHT), "passes_missed": plays(_MISSED),
        "passing_touchdowns": plays("play_type = 'Passing Touchdown'"), "rushes": plays(_RAN), "rushing_touchdowns": plays("play_type = 'Rushing Touchdown'"),
        "penalties_for": plays("play_type = 'Penalty' AND yards_gained > 0"), "penalties_against": plays("play_type = 'Penalty' AND yards_gained < 0"),
        "penalty_yards_for": yards("play_type = 'Penalty' AND yards_gained > 0"), "penalty_yards_against": "-" + yards("play_type = 'Penalty' AND yards_gained < 0"),
        "sacks": plays("play_type = 'Sack'"), "interceptions": plays("play_type = 'Interception Return'"),
        "fumbles": plays("play_type = 'Fumble Recovery (Opponent)'"), "punts_blocked": "0", "punts": plays("play_type = 'Punt'"), "fg_blocked": "0",
        "fg_attempts": plays("play_type IN ('Field Goal Good', 'Field Goal Missed')"), "fg_good": plays("play_type = 'Field Goal Good'"),
    }
    for t in (5, 10, 15, 20, 25):
        out[f"plays_over_{t}"] = plays(f"({_CAUGHT} OR {_RAN}) AND yards_gained >= {t}")
        out[f"passing_plays_over_{t}"] = plays(f"{_CAUGHT} AND yards_gained >= {t}")
        out[f"rushing_plays_over_{t}"] = plays(f"{_RAN} AND yards_gained >= {t}")
    for n, name in enumerate(("first", "second", "third", "fourth"), 1):
        out[f"{name}_downs"] = plays(f"{_TRIED} AND down = {n}")
        out[f"{name}_downs_converted"] = plays(f"{_TRIED} AND down = {n} AND success")
    return out


_DRIVES_SQL = {
    "redzone_drives": "count(DISTINCT CASE WHEN yards_to_goal <= 20 THEN drive_number END)",
    "redzone_touchdowns": "count(DISTINCT CASE WHEN yards_to_goal <= 20 AND play_type IN ('Passing Touchdown', 'Rushing Touchdown') THEN drive_number END)",
    "redzone_fgs": "count(DISTINCT CASE WHEN yards_to_goal <= 20 AND play_type = 'Field Goal Good' THEN drive_number END)",
    "possessions": "sum(CAST(opens AS INTEGER))",
    "possession_minutes": "sum(CASE WHEN opens THEN minutes * 60 + seconds ELSE 0 END) / 60",
}
_SUMS_SQL = {
    "yards": "passing_yards + rushing_yards", "pass_attempts": "passes_complete + passes_missed", "plays": "passes_complete + passes_missed + rushes",
    "turnovers": "interceptions + fumbles",
}
_OWN_SUMS_SQL = {"scoring_plays": "fg_good + passing_touchdowns + rushing_touchdowns", "redzone_scores": "redzone_touchdowns + redzone_fgs"}
_QUOTIENTS = {
    "completion_rate": "passes_complete/pass_attempts", "yards_per_pass": "passing_yards/pass_attempts", "yards_per_rush": "rushing_yards/rushes",
    "yards_per_play": "yards/plays", **{f"{d}_down_rate": f"{d}_downs_converted/{d}_downs" for d in ("first", "second", "third", "fourth")},
}
_OWN_QUOTIENTS = {
    "yards_per_completion": "passing_yards/passes_complete", "fg_rate": "fg_good/fg_attempts", "redzone_touchdown_rate": "redzone_touchdowns/redzone_drives",
    "redzone_fg_rate": "redzone_fgs/redzone_drives", "redzone_scoring_rate": "redzone_scores/redzone_drives",
    "minutes_per_possession": "possession_minutes/possessions", "minutes_per_play": "possession_minutes/plays",
}


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in p) + ")" for p in pairs)


def _features_sql() -> str:
    own = _measures_sql()
    faced = [m for m in own if m not in poll.OFFENCE_ONLY]
    forced = list(poll.FORCED)
    allowed = [m for m in (*faced, *_SUMS_SQL) if m not in forced]
    quotient = lambda n, q, side="": f"CAST({side}{q.split('/')[0]} AS DOUBLE) / nullif({side}{q.split('/')[1]}, 0) AS {side}{n}"
    additive = [*poll.RESULTS, *own, *_SUMS_SQL, *_OWN_SUMS_SQL, *_DRIVES_SQL, *[f"allowed_{m}" for m in allowed], *[f"forced_{m}" for m in forced]]
    shares = {**_QUOTIENTS, **_OWN_QUOTIENTS}
    pairs = [(f"cum_{n}", *[f"cum_{x}" for x in q.split("/")]) for n, q in shares.items()]
    pairs += [(f"cum_allowed_{n}", *[f"cum_allowed_{x}" for x in q.split("/")]) for n, q in _QUOTIENTS.items()]
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    raw = [*additive, *shares, *[f"allowed_{n}" for n in _QUOTIENTS]]
    same = lambda a, b: f"{a}.team = {b}.team AND {a}.year = {b}.year AND {a}.week = {b}.week"
    summed = [f"w_{m}" for m in ("win", "loss", "points", "points_allowed", "yards", "scoring_plays", "yards_per_play", "allowed_yards")]
    run = "OVER (PARTITION BY team, year, feature ORDER BY week ROWS UNBOUNDED PRECEDING)"
    return f"""WITH {_PBP_SQL}, {_POLL_SQL},
first_off AS (SELECT pos_team, year, week, min(game_id) AS game_id FROM pbp GROUP BY ALL),
off AS (
  SELECT p.pos_team AS team, p.year, p.week, arg_max(def_pos_team, k) AS opponent, max(offense_conference) AS conference,
         arg_max(pos_score, k) AS points, arg_max(def_score, k) AS points_allowed, {", ".join(f"{e} AS {n}" for n, e in {**own, **_DRIVES_SQL}.items())}
  FROM pbp p JOIN first_off f ON p.pos_team = f.pos_team AND p.year = f.year AND p.week = f.week AND p.game_id = f.game_id GROUP BY ALL),
own_sums AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in {**_SUMS_SQL, **_OWN_SUMS_SQL}.items())} FROM off),
own_shares AS (SELECT *, {", ".join(quotient(n, q) for n, q in shares.items())} FROM own_sums),
first_def AS (SELECT def_pos_team, year, week, min(game_id) AS game_id FROM pbp GROUP BY ALL),
def AS (
  SELECT p.def_pos_team AS team, p.year, p.week, {", ".join(f"{own[n]} AS {n}" for n in faced)}
  FROM pbp p JOIN first_def f ON p.def_pos_team = f.def_pos_team AND p.year = f.year AND p.week = f.week AND p.game_id = f.game_id GROUP BY ALL),
faced_sums AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _SUMS_SQL.items())} FROM def),
faced AS (SELECT team, year, week, {", ".join(f"{m} AS allowed_{m}" for m in allowed)}, {", ".join(f"{m} AS forced_{m}" for m in forced)},
          {", ".join(quotient(n, q).replace(f" AS {n}", f" AS allowed_{n}") for n, q in _QUOTIENTS.items())} FROM faced_sums),
grid AS (SELECT team, year, conference, CAST(week AS INTEGER) AS week FROM (SELECT DISTINCT team, year, conference FROM off), range(1, 16) t(week)),
cal AS (
  SELECT g.team, g.year, g.week, g.conference, opponent, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in raw if c not in ("margin", "win", "loss"))},
         CAST(points - points_allowed AS DOUBLE) AS margin, CAST(coalesce(CAST(points > points_allowed AS INTEGER), 0) AS DOUBLE) AS win,
         CAST(coalesce(CAST(points <= points_allowed AS INTEGER), 0) AS DOUBLE) AS loss
  FROM grid g LEFT JOIN own_shares o ON {same("g", "o")} AND g.conference = o.conference LEFT JOIN faced d ON {same("o", "d")}),
cells AS (SELECT team, year, week, feature, v FROM cal UNPIVOT INCLUDE NULLS (v FOR feature IN ({", ".join(raw)}))),
games AS (SELECT team, year, week, opponent, conference, count(opponent) OVER (PARTITION BY team, year ORDER BY week) AS games FROM cal),
sums AS (SELECT team, year, week, 'cum_' || feature AS feature, sum(coalesce(v, 0)) {run} AS v FROM cells WHERE feature IN ({listed(additive)})),
running AS (
  SELECT * FROM sums UNION ALL
  SELECT a.team, a.year, a.week, p.name, a.v / nullif(b.v, 0)
  FROM (VALUES {_values(pairs)}) p(name, up, down) JOIN sums a ON a.feature = p.up JOIN sums b ON b.feature = p.down AND {same("a", "b")}),
rate AS (SELECT g.team, g.year, g.week, s.v / nullif(games, 0) AS v FROM games g JOIN sums s ON {same("g", "s")} AND s.feature = 'cum_win'),
rated AS (
  SELECT * FROM cells UNION ALL SELECT * FROM running UNION ALL SELECT team, year, week, 'cum_win_rate', v FROM rate UNION ALL
  SELECT r.team, r.year, r.week, feature || '_per_game', v / nullif(games, 0) FROM running r JOIN games g ON {same("r", "g")}
  WHERE feature NOT IN ('cum_win', 'cum_loss')),
met AS (SELECT g.*, o.v AS strength FROM games g LEFT JOIN rate o ON g.opponent = o.team AND g.year = o.year AND g.week = o.week),
weighted AS (
  SELECT r.team, r.year, r.week, 'w_' || feature AS feature, CASE WHEN feature IN ('win', 'loss') THEN coalesce(v * strength, 0) ELSE v * strength END AS v
  FROM rated r JOIN met m ON {same("r", "m")} UNION ALL
  SELECT m.team, m.year, m.week, 'w_' || n.name || '_opponent', o.v * strength
  FROM met m CROSS JOIN (VALUES ('win'), ('points'), ('scoring_plays'), ('yards')) n(name)
  LEFT JOIN cells o ON o.feature = n.name AND m.opponent = o.team AND m.year = o.year AND m.week = o.week),
matched AS (
  SELECT a.team, a.year, a.week, 'm_' || p.mine AS feature, a.v * b.v AS v
  FROM (VALUES {_values(poll.MATCHUPS.items())}) p(mine, theirs) JOIN rated a ON a.feature = p.mine JOIN met m ON {same("a", "m")}
  LEFT JOIN rated b ON b.feature = p.theirs AND m.opponent = b.team AND m.year = b.year AND m.week = b.week UNION ALL
  SELECT a.team, a.year, a.week, 'm_allowed_plays', a.v * b.v FROM cells a JOIN sums b ON {same("a", "b")} WHERE a.feature = 'allowed_plays' AND b.feature = 'cum_scoring_plays'),
others AS (
  SELECT a.team, a.year, a.week, 'cum_margin_product' AS feature, a.v * b.v AS v FROM sums a JOIN met m ON {same("a", "m")}
  LEFT JOIN sums b ON b.feature = 'cum_margin' AND m.opponent = b.team AND m.year = b.year AND m.week = b.week WHERE a.feature = 'cum_margin' UNION ALL
  SELECT a.team, a.year, a.week, 'adjusted_win_rate', (a.v - r.v * strength) / nullif(games, 0)
  FROM sums a JOIN rate r ON {same("a", "r")} JOIN met m ON {same("a", "m")} WHERE a.feature = 'cum_win'),
weighted_sums AS (
  SELECT team, year, week, 'cum_' || feature AS feature, sum(coalesce(v, 0)) {run} AS v
  FROM (SELECT * FROM weighted WHERE feature IN ({listed([*summed, *[f"w_{m}_opponent" for m in poll.OPPONENT_RESULTS]])}) UNION ALL SELECT * FROM matched)),
polled AS (SELECT c.team, c.year, c.week, c.opponent, c.conference, coalesce(votes, 0) AS votes FROM games c LEFT JOIN poll p ON {same("c", "p")}),
kept AS (SELECT * FROM polled WHERE conference IN (SELECT conference FROM polled GROUP BY 1 HAVING sum(votes) > 0.1)),
lagged AS (SELECT *, coalesce(lag(ln(CASE WHEN votes = 0 THEN 0.1 ELSE votes END)) OVER (PARTITION BY team, year ORDER BY week), ln(0.1)) AS lag_log FROM kept),
votes AS (SELECT a.team, a.year, a.week, b.lag_log AS vote FROM lagged a LEFT JOIN lagged b ON a.opponent = b.team AND a.year = b.year AND a.week = b.week),
voted AS (
  SELECT r.team, r.year, r.week, 'v_' || feature AS feature, CASE WHEN feature IN ('win', 'loss') THEN coalesce(v * vote, 0) ELSE v * vote END AS v
  FROM rated r JOIN votes o ON {same("r", "o")} WHERE feature IN ({listed(poll.VOTE_WEIGHTED)})),
voted_sums AS (SELECT team, year, week, 'cum_' || feature AS feature, sum(coalesce(v, 0)) {run} AS v FROM voted),
means AS (
  SELECT s.team, s.year, s.week, feature || '_per_game' AS feature, v / nullif(games, 0) AS v
  FROM (SELECT * FROM weighted_sums UNION ALL SELECT * FROM voted_sums) s JOIN games g ON {same("s", "g")}),
flags AS (
  SELECT a.* FROM (SELECT * FROM cells WHERE feature IN ('win', 'loss') UNION ALL SELECT * FROM weighted WHERE feature IN ('w_win', 'w_loss')) a JOIN votes o ON {same("a", "o")}
  UNION ALL SELECT * FROM voted WHERE feature IN ('v_win', 'v_loss')),
lags AS (SELECT team, year, week, 'lag_' || feature AS feature, coalesce(lag(v) OVER (PARTITION BY team, year, feature ORDER BY week), 0) AS v FROM flags),
everything AS (
  SELECT * FROM rated UNION ALL SELECT * FROM weighted UNION ALL SELECT * FROM matched UNION ALL SELECT * FROM others UNION ALL SELECT * FROM weighted_sums UNION ALL
  SELECT * FROM voted UNION ALL SELECT * FROM voted_sums UNION ALL SELECT * FROM means UNION ALL SELECT * FROM lags),
shown AS (
  SELECT e.team, e.year, e.week, feature, v, CASE WHEN abs(v) >= 1e-9 THEN CAST(floor(log10(abs(v))) AS BIGINT) WHEN v IS NOT NULL THEN 0 END AS e10
  FROM everything e JOIN votes o ON {same("e", "o")}),
figures AS (
  SELECT *, CASE WHEN abs(v) < 1e-9 THEN 0 WHEN e10 <= 5 THEN CAST(floor(v * power(10.0::DOUBLE, 5 - e10) + 0.3717) AS BIGINT)
                 ELSE CAST(floor(v / power(10.0::DOUBLE, e10 - 5) + 0.3717) AS BIGINT) END AS digits FROM shown)
SELECT team, year, feature, count(v) AS known, CAST(sum(week * e10) AS BIGINT) AS magnitudes, CAST(sum(week * week * digits) AS BIGINT) AS digits FROM figures GROUP BY ALL"""


@query("poll_feature_vectors", _features_sql())
def poll_feature_vectors(spark, sf):
    """Every generated feature of every team-week: six figures and the magnitude of each value, summed over the season with
    the week as weight, so that no value can differ unseen."""
    vectors, _ = poll_vectors.season_vectors(play_by_play(spark, sf), poll_votes(spark, sf), PLAY_ORDER)
    cells = vectors.long(poll.KEYS)
    v, size = F.col("value"), F.abs("value")
    e10 = F.when(size >= 1e-9, F.floor(F.log10(size))).when(v.isNotNull(), F.lit(0))
    cells = cells.withColumn("e10", e10.cast("long"))
    power = lambda n: F.pow(F.lit(10.0), n)
    digits = F.when(size < 1e-9, F.lit(0)).when(F.col("e10") <= 5, F.floor(v * power(5 - F.col("e10")) + 0.3717)).otherwise(F.floor(v / power(F.col("e10") - 5) + 0.3717))
    week = F.col("week").cast("long")
    return cells.withColumn("figures", digits.cast("long")).groupBy("team", "year", "feature").agg(
        F.count("value").alias("known"), F.sum(week * F.col("e10")).alias("magnitudes"), F.sum(week * week * F.col("figures")).alias("digits")
    )
