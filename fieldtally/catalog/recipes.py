"""Whole analyses on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.prepare import latest_period
from ..plans import cards as cards_plan
from ..plans import listening, poll, poll_model, pyramid
from ..plans import votes as votes_plan
from ..sources.files import table
from .registry import query
from .tables import BLOCK_WEEK_SQL, PLAY_KEY_SQL, PLAY_ORDER, PLAYS_SQL, plays

# Orders as games: how a line's flags read as a play type
_PLAY_TYPE_SQL = """CASE
    WHEN kind = 'A' THEN CASE WHEN status = 'F' THEN 'Pass Reception' WHEN stage = 1 THEN 'Passing Touchdown' ELSE 'Pass Incompletion' END
    WHEN kind = 'R' THEN CASE WHEN status = 'F' THEN 'Rush' WHEN stage = 2 THEN 'Rushing Touchdown' ELSE 'Sack' END
    ELSE CASE WHEN stage <= 2 THEN 'Punt' WHEN stage = 3 THEN 'Field Goal Good' WHEN stage = 4 THEN 'Field Goal Missed'
              WHEN stage = 5 THEN 'Penalty' WHEN stage = 6 THEN 'Interception Return' ELSE 'Fumble Recovery (Opponent)' END END"""

_PBP_SQL = f"""{PLAYS_SQL},
pbp AS (
  SELECT team AS pos_team, opp AS def_pos_team, region.r_name AS offense_conference, year, week,
         year * 1000 + week * 10 + CASE WHEN day(l_shipdate) > 28 THEN 1 ELSE 0 END AS game_id, drive AS drive_number,
         {_PLAY_TYPE_SQL} AS play_type, yards - 10 AS yards_gained, (stage - 1) % 4 + 1 AS down, status = 'F' AS success,
         floor(discount * 500) AS yards_to_goal, stage = 1 AS opens, stage AS minutes, yards AS seconds,
         points AS pos_score, yards * 1499.37::DOUBLE AS def_score, {PLAY_KEY_SQL} AS k
  FROM plays JOIN nation ON team = n_name JOIN region ON n_regionkey = r_regionkey
)"""


def play_by_play(spark, sf):
    """The plays in the shape of a play-by-play feed."""
    p = plays(spark, sf)
    regions = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("team"), F.col("r_name").alias("offense_conference"))
    kind, done, stage = F.col("kind"), F.col("status") == "F", F.col("stage")
    play_type = (
        F.when(kind == "A", F.when(done, "Pass Reception").when(stage == 1, "Passing Touchdown").otherwise("Pass Incompletion"))
        .when(kind == "R", F.when(done, "Rush").when(stage == 2, "Rushing Touchdown").otherwise("Sack"))
        .otherwise(
            F.when(stage <= 2, "Punt").when(stage == 3, "Field Goal Good").when(stage == 4, "Field Goal Missed")
            .when(stage == 5, "Penalty").when(stage == 6, "Interception Return").otherwise("Fumble Recovery (Opponent)")
        )
    )
    late = (F.dayofmonth("l_shipdate") > 28).cast("int")
    return p.join(regions, "team").select(
        F.col("team").alias("pos_team"), F.col("opp").alias("def_pos_team"), "offense_conference", F.col("team").alias("offense_play"),
        "year", "week", (F.col("year") * 1000 + F.col("week") * 10 + late).alias("game_id"), F.col("drive").alias("drive_number"),
        play_type.alias("play_type"), (F.col("yards") - 10).alias("yards_gained"), ((stage - 1) % 4 + 1).alias("down"),
        done.cast("int").alias("success"), F.floor(F.col("discount") * 500).alias("yards_to_goal"),
        F.when(stage == 1, 1).otherwise(0).alias("drive_numbers"), stage.cast("double").alias("drive_time_minutes_elapsed"),
        F.col("yards").alias("drive_time_seconds_elapsed"), F.col("points").alias("pos_team_score"),
        (F.col("yards") * 1499.37).alias("def_pos_team_score"), *PLAY_ORDER,
    )


_POLL_SQL = """poll AS (
  SELECT n_name AS team, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS week,
         floor(sum(o_totalprice) / 1000) AS votes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND n_regionkey <> 4 GROUP BY ALL)"""


def poll_votes(spark, sf):
    """Votes a nation gets from its urgent pending orders; one region never gets any."""
    n = table(spark, sf, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("team"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, sf, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return (
        o.join(c, "o_custkey").join(n, "c_nationkey")
        .groupBy("team", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("week"))
        .agg(F.floor(F.sum("o_totalprice") / 1000).alias("votes"))
    )


def features(spark, sf, columns):
    return poll.season_features(play_by_play(spark, sf), poll_votes(spark, sf), PLAY_ORDER, columns=columns)


_W = "OVER (PARTITION BY team, year ORDER BY week ROWS UNBOUNDED PRECEDING)"
_FEATURE_SQL = f"""WITH {_PBP_SQL}, {_POLL_SQL},
first_off AS (SELECT pos_team, year, week, min(game_id) AS game_id FROM pbp GROUP BY ALL),
off AS (
  SELECT p.pos_team AS team, p.year, p.week, arg_max(def_pos_team, k) AS opponent, max(offense_conference) AS conference,
         arg_max(pos_score, k) AS points, arg_max(def_score, k) AS points_allowed,
         coalesce(sum(yards_gained) FILTER (WHERE play_type IN ('Pass Reception', 'Passing Touchdown')), 0) AS passing_yards,
         coalesce(sum(yards_gained) FILTER (WHERE play_type IN ('Rush', 'Rushing Touchdown')), 0) AS rushing_yards,
         count(*) FILTER (WHERE play_type IN ('Pass Reception', 'Passing Touchdown')) AS passes_complete,
         count(*) FILTER (WHERE play_type IN ('Pass Incompletion', 'Interception Return')) AS passes_missed,
         count(*) FILTER (WHERE play_type IN ('Rush', 'Rushing Touchdown')) AS rushes,
         count(DISTINCT CASE WHEN yards_to_goal <= 20 THEN drive_number END) AS redzone_drives,
         CAST(sum(CAST(opens AS INTEGER)) AS BIGINT) AS possessions,
         sum(CASE WHEN opens THEN minutes * 60 + seconds ELSE 0 END) / 60 AS possession_minutes,
         count(*) FILTER (WHERE down = 4 AND play_type IN ('Pass Reception', 'Passing Touchdown', 'Pass Incompletion', 'Rush', 'Rushing Touchdown', 'Sack', 'Interception Return', 'Fumble Recovery (Opponent)')) AS fourth_downs,
         count(*) FILTER (WHERE down = 4 AND success AND play_type IN ('Pass Reception', 'Passing Touchdown', 'Pass Incompletion', 'Rush', 'Rushing Touchdown', 'Sack', 'Interception Return', 'Fumble Recovery (Opponent)')) AS fourth_downs_converted
  FROM pbp p JOIN first_off f ON p.pos_team = f.pos_team AND p.year = f.year AND p.week = f.week AND p.game_id = f.game_id GROUP BY ALL),
first_def AS (SELECT def_pos_team, year, week, min(game_id) AS game_id FROM pbp GROUP BY ALL),
def AS (
  SELECT p.def_pos_team AS team, p.year, p.week,
         coalesce(sum(yards_gained) FILTER (WHERE play_type IN ('Pass Reception', 'Passing Touchdown', 'Rush', 'Rushing Touchdown')), 0) AS allowed_yards,
         count(*) FILTER (WHERE play_type IN ('Interception Return', 'Fumble Recovery (Opponent)')) AS forced_turnovers
  FROM pbp p JOIN first_def f ON p.def_pos_team = f.def_pos_team AND p.year = f.year AND p.week = f.week AND p.game_id = f.game_id GROUP BY ALL),
grid AS (SELECT team, year, conference, CAST(week AS INTEGER) AS week FROM (SELECT DISTINCT team, year, conference FROM off), range(1, 16) t(week)),
cal AS (
  SELECT g.team, g.year, g.conference, g.week, opponent, points, points_allowed, passing_yards, rushing_yards, passing_yards + rushing_yards AS yards,
         passes_complete, passes_missed, rushes, passes_complete + passes_missed + rushes AS plays, redzone_drives, possessions, possession_minutes,
         fourth_downs, fourth_downs_converted, allowed_yards, forced_turnovers,
         coalesce(CAST(points > points_allowed AS INTEGER), 0) AS win, coalesce(CAST(points <= points_allowed AS INTEGER), 0) AS loss
  FROM grid g LEFT JOIN off o ON g.team = o.team AND g.year = o.year AND g.week = o.week AND g.conference = o.conference
  LEFT JOIN def d ON o.team = d.team AND o.year = d.year AND o.week = d.week),
run AS (
  SELECT *, count(opponent) {_W} AS games, sum(win) {_W} AS cum_win, sum(coalesce(points - points_allowed, 0)) {_W} AS cum_margin,
         sum(coalesce(points, 0)) {_W} AS cum_points, sum(coalesce(points_allowed, 0)) {_W} AS cum_points_allowed, sum(coalesce(yards, 0)) {_W} AS cum_yards,
         sum(coalesce(allowed_yards, 0)) {_W} AS cum_allowed_yards, sum(coalesce(plays, 0)) {_W} AS cum_plays,
         sum(coalesce(fourth_downs, 0)) {_W} AS cum_fourth, sum(coalesce(fourth_downs_converted, 0)) {_W} AS cum_fourth_ok,
         sum(coalesce(redzone_drives, 0)) {_W} AS cum_redzone, sum(coalesce(possession_minutes, 0)) {_W} AS cum_minutes, sum(coalesce(forced_turnovers, 0)) {_W} AS cum_forced
  FROM cal),
rated AS (SELECT *, cum_win / nullif(games, 0) AS win_rate FROM run),
paired AS (
  SELECT a.*, b.win_rate AS rate_opp, b.cum_points_allowed / nullif(b.games, 0) AS allowed_opp, b.cum_points / nullif(b.games, 0) AS points_opp
  FROM rated a LEFT JOIN rated b ON a.opponent = b.team AND a.year = b.year AND a.week = b.week),
weighted AS (
  SELECT *, coalesce(win * rate_opp, 0) AS w_win, coalesce(loss * rate_opp, 0) AS w_loss, points * allowed_opp AS m_points,
         points_allowed * points_opp AS m_points_allowed FROM paired),
wrun AS (SELECT *, sum(w_win) {_W} AS cum_w_win, sum(coalesce(m_points, 0)) {_W} AS cum_m_points, sum(coalesce(m_points_allowed, 0)) {_W} AS cum_m_points_allowed FROM weighted),
polled AS (SELECT c.team, c.year, c.week, c.opponent, c.conference, coalesce(votes, 0) AS votes FROM cal c
           LEFT JOIN poll p ON c.team = p.team AND c.year = p.year AND c.week = p.week),
kept AS (SELECT * FROM polled WHERE conference IN (SELECT conference FROM polled GROUP BY 1 HAVING sum(votes) > 0.1)),
lagged AS (SELECT *, ln(CASE WHEN votes = 0 THEN 0.1 ELSE votes END) AS log_votes,
                  coalesce(lag(ln(CASE WHEN votes = 0 THEN 0.1 ELSE votes END)) OVER (PARTITION BY team, year ORDER BY week), ln(0.1)) AS lag_log FROM kept),
opp AS (SELECT a.*, b.lag_log AS lag_log_opp FROM lagged a LEFT JOIN lagged b ON a.opponent = b.team AND a.year = b.year AND a.week = b.week),
voted AS (SELECT w.*, votes, log_votes, lag_log, w.yards * lag_log_opp AS v_yards, coalesce(w.win * lag_log_opp, 0) AS v_win
          FROM wrun w JOIN opp o ON w.team = o.team AND w.year = o.year AND w.week = o.week)
SELECT team, year, week, conference, opponent, points, points_allowed, win, loss, yards, plays, redzone_drives,
       possessions, round(possession_minutes, 6) AS possession_minutes, allowed_yards, forced_turnovers, games,
       CAST(cum_win AS BIGINT) AS cum_win, round(cum_margin, 2) AS cum_margin, round(win_rate, 6) AS cum_win_rate,
       round(cum_points / nullif(games, 0), 6) AS cum_points_per_game, round(cum_yards / nullif(cum_plays, 0), 6) AS cum_yards_per_play,
       round(cum_allowed_yards / nullif(games, 0), 6) AS cum_allowed_yards_per_game, round(cum_fourth_ok / nullif(cum_fourth, 0), 6) AS cum_fourth_down_rate,
       CAST(cum_redzone AS BIGINT) AS cum_redzone_drives, round(cum_minutes / nullif(games, 0), 6) AS cum_possession_minutes_per_game,
       CAST(cum_forced AS BIGINT) AS cum_forced_turnovers, round(w_win, 6) AS w_win, round(cum_w_win / nullif(games, 0), 6) AS cum_w_win_per_game,
       round(m_points / 1e6, 4) AS m_points, round(cum_m_points / 1e6, 4) AS cum_m_points, round(cum_m_points_allowed / nullif(games, 0) / 1e6, 4) AS cum_m_points_allowed_per_game,
       round(log_votes, 6) AS log_votes, round(lag_log, 6) AS lag_log_votes, round(v_yards, 4) AS v_yards,
       round(sum(coalesce(v_yards, 0)) {_W}, 4) AS cum_v_yards, round(sum(v_win) {_W} / nullif(games, 0), 6) AS cum_v_win_per_game,
       CAST(coalesce(lag(win) OVER (PARTITION BY team, year ORDER BY week), 0) AS DOUBLE) AS lag_win,
       round(coalesce(lag(w_loss) OVER (PARTITION BY team, year ORDER BY week), 0), 6) AS lag_w_loss,
       round(coalesce(lag(v_win) OVER (PARTITION BY team, year ORDER BY week), 0), 6) AS lag_v_win
FROM voted"""

# output column -> decimals (None: as it is), scaled by a million where listed in _MILLIONS
_SHOWN = {
    **dict.fromkeys(["team", "year", "week", "conference", "opponent", "points", "points_allowed", "win", "loss", "yards", "plays", "redzone_drives", "possessions"]),
    "possession_minutes": 6, "allowed_yards": None, "forced_turnovers": None, "games": None, "cum_win": None, "cum_margin": 2, "cum_win_rate": 6,
    "cum_points_per_game": 6, "cum_yards_per_play": 6, "cum_allowed_yards_per_game": 6, "cum_fourth_down_rate": 6, "cum_redzone_drives": None,
    "cum_possession_minutes_per_game": 6, "cum_forced_turnovers": None, "w_win": 6, "cum_w_win_per_game": 6, "m_points": 4, "cum_m_points": 4,
    "cum_m_points_allowed_per_game": 4, "log_votes": 6, "lag_log_votes": 6, "v_yards": 4, "cum_v_yards": 4, "cum_v_win_per_game": 6,
    "lag_win": None, "lag_w_loss": 6, "lag_v_win": 6,
}
_MILLIONS = ("m_points", "cum_m_points", "cum_m_points_allowed_per_game")


@query("poll_features", _FEATURE_SQL)
def poll_features(spark, sf):
    """The flagship: plays to vote-weighted season features."""
    def shown(name, digits):
        c = F.col(name) / 1e6 if name in _MILLIONS else F.col(name)
        return (c if digits is None else F.round(c, digits)).alias(name)

    return features(spark, sf, list(_SHOWN)).select(*[shown(n, d) for n, d in _SHOWN.items()])


@query("stacked_model")
def stacked_model(spark, sf):
    """The last month's votes predicted from the months before, as a rank report."""
    played = features(spark, sf, None).where(F.col("opponent").isNotNull())
    table_, names = poll_model.model_table(played)
    target = latest_period(table_, "year", "week", ahead=0)
    return poll_model.rank_report(poll_model.predict_poll(table_, names, target))


def listening_export(spark, sf):
    """Events in the shape of a listening export; errors are spoken items, some rows hold neither."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.floor(F.col("value") * 1000).alias("ms_played"),
        F.nullif(kind, F.lit("error")).alias("master_metadata_track_name"),
        F.when(F.col("user_id") == 3, "Pink Noise").when(F.col("user_id") != 5, F.concat(F.lit("user "), F.col("user_id"))).alias("master_metadata_album_artist_name"),
        F.col("props").alias("master_metadata_album_album_name"), F.col("event_id").cast("string").alias("reason_start"),
        kind.alias("reason_end"), F.lit(False).alias("shuffle"), F.lit(False).alias("skipped"),
        F.when((kind == "error") & (F.col("value") > 5), "show").alias("episode_show_name"),
    )


_HISTORY_SQL = f"""export AS (
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, date_trunc('second', ts) AS played_at, CAST(floor(value * 1000) AS BIGINT) AS ms_played,
         nullif(event_type, 'error') AS track_name, CASE WHEN user_id = 3 THEN 'Pink Noise' WHEN user_id <> 5 THEN 'user ' || user_id END AS artist,
         CASE WHEN event_type = 'error' AND value > 5 THEN 'show' END AS spoken FROM events),
history AS (
  SELECT *, CASE WHEN track_name IS NULL THEN 'show/podcast/book' ELSE 'song' END AS type, CAST(played_at AS DATE) AS day_date, {BLOCK_WEEK_SQL.format(c='played_at')} AS week
  FROM export WHERE NOT (track_name IS NULL AND spoken IS NULL)),
rows AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY track_name NULLS FIRST, artist NULLS FIRST, ms_played, event_id) AS rn FROM history
    WHERE year(played_at) >= 2014 AND (artist <> 'Pink Noise' OR artist IS NULL) AND year(played_at) <= 2024 AND ms_played <> 0) WHERE rn = 1)"""


def history_rows(spark, sf):
    clean = listening.clean_history(listening_export(spark, sf)).withColumns(
        {"day_date": F.to_date("at"), "event_id": F.col("reason_start").cast("long")}
    )
    return listening.analysis_rows(clean, "2025-06-01", ["track_name", "artist", "ms_played", "event_id"])


@query(
    "listening_leaders",
    f"""WITH {_HISTORY_SQL}, sums AS (SELECT artist, round(sum(ms_played / 1000), 6) AS seconds FROM rows WHERE type = 'song' GROUP BY 1),
      top AS (SELECT artist FROM (SELECT artist, rank() OVER (ORDER BY seconds DESC) AS r FROM sums) WHERE r <= 10),
      daily AS (SELECT artist, day_date, round(sum(ms_played / 1000), 6) AS seconds FROM rows
                WHERE type = 'song' AND artist IN (SELECT artist FROM top) GROUP BY ALL)
      SELECT artist, day_date, seconds, round(sum(seconds) OVER (PARTITION BY artist ORDER BY day_date), 6) / 3600 AS total_hours FROM daily""",
)
def listening_leaders(spark, sf):
    return listening.cumulative_leaders(history_rows(spark, sf), "artist", 10, "day_date")


@query(
    "listening_weekly",
    f"""WITH {_HISTORY_SQL}, sums AS (SELECT week, type, round(sum(ms_played / 1000), 6) AS seconds, count(*) AS plays FROM rows GROUP BY ALL)
      SELECT week, type, seconds, seconds / 60 AS minutes, seconds / 60 / 60 AS hours, seconds / 60 / 60 / 24 AS days, plays FROM sums""",
)
def listening_weekly(spark, sf):
    return listening.time_by(history_rows(spark, sf), ["week", "type"])


@query(
    "vote_map",
    """WITH returns AS (
         SELECT n_name AS state, c_mktsegment || ' ' || (c_custkey // 10) AS county_name, CASE o_orderstatus WHEN 'O' THEN 'DEMOCRAT' WHEN 'F' THEN 'REPUBLICAN' ELSE 'OTHER' END AS party,
                CASE WHEN o_orderpriority = '1-URGENT' AND n_regionkey < 2 THEN 'TOTAL' ELSE o_orderpriority END AS mode,
                floor(o_totalprice) AS candidatevotes, floor(o_totalprice) * 3 + 1000 AS totalvotes
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) = 1997),
       two AS (SELECT * FROM returns WHERE party <> 'OTHER'), states AS (SELECT DISTINCT state FROM two WHERE mode = 'TOTAL'),
       totals AS (SELECT state, county_name, party, candidatevotes, totalvotes FROM two WHERE mode = 'TOTAL' UNION ALL
                  SELECT state, county_name, party, sum(candidatevotes), avg(totalvotes) FROM two WHERE state NOT IN (SELECT state FROM states) GROUP BY ALL),
       firsts AS (SELECT state, county_name, party, round_even(candidatevotes / totalvotes, 3) AS share, totalvotes FROM (
         SELECT *, row_number() OVER (PARTITION BY state, county_name, party ORDER BY candidatevotes, totalvotes) AS rn FROM totals) WHERE rn = 1),
       wide AS (SELECT state, county_name, max(share) FILTER (WHERE party = 'DEMOCRAT') AS d, max(share) FILTER (WHERE party = 'REPUBLICAN') AS r,
                       max(totalvotes) FILTER (WHERE party = 'DEMOCRAT') AS tv FROM firsts GROUP BY ALL),
       lead AS (SELECT *, CASE WHEN d IS NULL OR r IS NULL THEN NULL WHEN r >= d THEN -r ELSE d END AS diff FROM wide),
       unit AS (SELECT *, CASE WHEN diff < 0 THEN 1 + diff ELSE diff END AS u FROM lead),
       counties AS (SELECT DISTINCT n_name AS state, c_mktsegment || ' ' || (c_custkey // 10) AS county_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT state, county_name, d AS "Democrat", r AS "Republican", round(tv, 4) AS "TotalVotes", u AS diff,
         CASE WHEN u < 0 THEN NULL WHEN u < 0.05::DOUBLE THEN '95%+ Republican' WHEN u < 0.15::DOUBLE THEN '85% to 95% Republican' WHEN u < 0.25::DOUBLE THEN '75% to 85% Republican'
              WHEN u < 0.35::DOUBLE THEN '65% to 75% Republican' WHEN u < 0.45::DOUBLE THEN '55% to 65% Republican' WHEN u < 0.55::DOUBLE THEN '55% Republican to 55% Democrat'
              WHEN u < 0.65::DOUBLE THEN '55% to 65% Democrat' WHEN u < 0.75::DOUBLE THEN '65% to 75% Democrat' WHEN u < 0.85::DOUBLE THEN '75% to 85% Democrat'
              WHEN u < 0.95::DOUBLE THEN '85% to 95% Democrat' WHEN u <= 1 THEN '95%+ Democrat' END AS map_class
       FROM unit JOIN counties USING (state, county_name)""",
)
def vote_map(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    county = F.concat_ws(" ", "c_mktsegment", F.floor(F.col("c_custkey") / 10))
    people = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_regionkey", F.col("n_name").alias("state"), county.alias("county_name"))
    o = table(spark, sf, "orders")
    status, votes_cast = F.col("o_orderstatus"), F.floor("o_totalprice").cast("double")
    reported = (F.col("o_orderpriority") == "1-URGENT") & (F.col("n_regionkey") < 2)
    returns = o.join(people, o.o_custkey == people.c_custkey).select(
        "state", "county_name", F.year("o_orderdate").alias("year"),
        F.when(status == "O", "DEMOCRAT").when(status == "F", "REPUBLICAN").otherwise("OTHER").alias("party"),
        F.when(reported, "TOTAL").otherwise(F.col("o_orderpriority")).alias("mode"),
        votes_cast.alias("candidatevotes"), (votes_cast * 3 + 1000).alias("totalvotes"),
    )
    out = votes_plan.vote_map(returns, people.select("state", "county_name").distinct(), 1997)
    return out.withColumn("TotalVotes", F.round("TotalVotes", 4))


@query(
    "population_pyramid",
    """WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 'Male' ELSE 'Female' END AS g, CAST(l_quantity * 1.8 AS INTEGER) AS age FROM lineitem WHERE l_returnflag <> 'N'),
       b AS (SELECT g, least(age // 5, 17) AS b FROM p)
       SELECT g AS "Gender", CASE b WHEN 0 THEN 'Under 5' WHEN 17 THEN '85 and Up' ELSE (b * 5) || ' to ' || (b * 5 + 4) END AS "Age_Group",
              CASE g WHEN 'Male' THEN -count(*) ELSE count(*) END AS "Count", CAST(b + 1 AS INTEGER) AS sort_key FROM b GROUP BY g, b
       UNION ALL SELECT g, CASE b WHEN 0 THEN 'Under 5' WHEN 17 THEN '85 and Up' ELSE (b * 5) || ' to ' || (b * 5 + 4) END, 0, CAST(b + 1 AS INTEGER)
       FROM (SELECT unnest(['Male', 'Female']) AS g) CROSS JOIN (SELECT unnest(range(18)) AS b) s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.g = g AND b.b = s.b)
         AND (g, s.b) NOT IN (SELECT g, b FROM b)""",
)
def population_pyramid(spark, sf):
    """Line items as people, suppliers as tracts: a wide table with one column per sex and age."""
    sex = F.when(F.col("l_returnflag") == "A", "Male").otherwise("Female")
    age = F.bround(F.col("l_quantity") * 1.8).cast("int")
    people = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select("l_suppkey", sex.alias("sex"), age.alias("age"))

    def covers(label):
        if label == "Under_5":
            return F.col("age") < 5
        if label == "85_and_Up":
            return F.col("age") >= 85
        lo, _, hi = label.partition("_to_")
        return F.col("age").between(int(lo), int(hi or lo))

    columns = pyramid.age_columns()
    counts = [
        F.count_if((F.col("sex") == c.split("_", 1)[0]) & covers(c.split("_", 1)[1][:-1])).alias(c) for c in columns
    ]
    return pyramid.pyramid(people.groupBy("l_suppkey").agg(*counts))


@query(
    "card_colours",
    """WITH c AS (SELECT p_name || ' ' || p_brand AS name, p_type, p_size, p_retailprice, year FROM part LEFT JOIN (
                    SELECT l_partkey, min(CAST(year(l_shipdate) AS INTEGER)) AS year FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
                  WHERE p_type <> 'PROMO'),
       g AS (SELECT name, min(year) AS y FROM c GROUP BY 1 HAVING count(year) = count(*)),
       f AS (SELECT DISTINCT c.name, p_retailprice AS cmc, p_size, year, p_type, length(c.name) AS len FROM c JOIN g ON c.name = g.name AND year = y WHERE p_size <> 7),
       k AS (SELECT *, p_size * 1.0::DOUBLE AS power, p_size * 2.0::DOUBLE AS toughness,
                    CASE p_type WHEN 'SMALL' THEN 'White' WHEN 'LARGE' THEN 'Blue' WHEN 'ECONOMY' THEN 'Red' WHEN 'STANDARD' THEN 'Green' END AS colour FROM f)
       SELECT year AS release_year, colour, count(*) AS num_new_cards, round(avg(power), 6) AS avg_power, round(avg(toughness), 6) AS avg_toughness,
              round(avg(cmc), 6) AS avg_cmc, round(avg(len), 6) AS avg_text_len, round(sum(power) / sum(toughness), 6) AS power_per_toughness,
              round(sum(power) / sum(cmc), 6) AS power_per_cost, round(sum(toughness) / sum(cmc), 6) AS toughness_per_cost,
              round((sum(power) + sum(toughness)) / sum(cmc), 6) AS strength_per_cost, round((sum(power) + sum(toughness)) / sum(len), 6) AS strength_per_text
       FROM k WHERE colour IS NOT NULL GROUP BY ALL""",
)
def card_colours(spark, sf):
    """Parts as cards: the type is the colour, the size the strength, seven stands for unknown."""
    p = table(spark, sf, "part")
    size = F.col("p_size")
    identity = F.create_map(*[F.lit(x) for kv in {"SMALL": "['W']", "LARGE": "['U']", "ECONOMY": "['R']", "STANDARD": "['G']", "MEDIUM": "['W', 'U']"}.items() for x in kv])
    deck = p.select(
        F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.concat(F.lit("set "), F.col("p_partkey")).alias("set"),
        F.when(F.col("p_type") != "PROMO", "Creature").otherwise("Artifact").alias("type"), F.lit("normal").alias("layout"),
        F.when(size == 7, "*").otherwise(size.cast("string")).alias("power"), (size * 2).cast("string").alias("toughness"),
        F.get(F.array(identity[F.col("p_type")]), F.lit(0)).alias("color_identity"), F.concat_ws(" ", "p_name", "p_brand").alias("text"),
        F.col("p_retailprice").alias("cmc"),
    )
    years = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).alias("release_year"))
    sets = years.select(F.concat(F.lit("set "), F.col("l_partkey")).alias("set_name"), "release_year")
    return cards_plan.trends(cards_plan.with_colour(cards_plan.first_printings(deck, sets)), ["release_year", "colour"])
