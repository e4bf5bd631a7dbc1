"""The season features of :mod:`poll` with the measures in arrays: two folds, one join with the opponents, one with the votes.

The wide plan treats some nine hundred columns one by one; here the same rules are applied to vectors, and a
caller gets all features as rows (``long``) or the ones it wants as columns (``wide``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import safe_ratio
from ..operators.joins import left_attach
from ..operators.vectors import Vectors, divided, filled, packed, positions, product, ratios, running_vectors, scaled, taken
from ..operators.windows import lagged
from ..session import store
from . import poll
from .poll import KEYS, ORDER, SEASON


def raw_names() -> list[str]:
    """The measures of a team's week: first the additive ones, then the ratios."""
    allowed = [f"allowed_{r}" for r in poll.RATIOS]
    return [*poll.additive_measures(), *poll.RATIOS, *poll.RATIOS_OFFENCE, *allowed]


def rated_names() -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """(running names, those also given per game, the ratios of running sums)."""
    sums = [f"cum_{m}" for m in poll.additive_measures()]
    pairs = {f"cum_{n}": (f"cum_{a}", f"cum_{b}") for n, (a, b) in poll._all_ratios().items()}
    have = set(sums)
    pairs = {n: p for n, p in pairs.items() if have.issuperset(p)}
    running = [*sums, *pairs]
    return running, [n for n in running if n not in ("cum_win", "cum_loss")], list(pairs.values())


def feature_vectors(calendar: DataFrame, polled: DataFrame, zero_fill_win: bool = True) -> Vectors:
    """``calendar``: team-weeks with all measures; ``polled``: the rows of :func:`poll.poll_rows`."""
    raw = raw_names()
    additive = len(poll.additive_measures())
    weeks = calendar.select(*KEYS, "opponent", "conference", packed(raw).alias("raw"))
    weeks = weeks.withColumn("counted", F.concat(F.slice("raw", 1, additive), F.array(F.col("opponent").isNotNull().cast("double"))))
    run = running_vectors(weeks, SEASON, ORDER[0], {"sums": "counted"})
    run = run.withColumn("games", F.get("sums", F.lit(additive)).cast("long")).withColumn("sums", F.slice("sums", 1, additive))

    running, averaged, pairs = rated_names()
    sums = [f"cum_{m}" for m in poll.additive_measures()]
    run = run.withColumn("running", F.concat("sums", ratios(F.col("sums"), [tuple(positions(sums, p)) for p in pairs])))
    rate = F.try_divide(F.get("sums", F.lit(sums.index("cum_win"))), F.col("games"))
    run = run.withColumn("rated", F.concat("raw", "running", F.array(rate), divided(taken(F.col("running"), positions(running, averaged)), F.col("games"))))
    names = [*raw, *running, "cum_win_rate", *[f"{n}_per_game" for n in averaged]]
    rated = store(run.select(*KEYS, "opponent", "conference", "games", "rated"), "poll-rated")

    # what the opponent has at that time: its strength, its margin, what it usually allows, its results
    theirs = ["cum_win_rate", "cum_margin", *sorted(set(poll.MATCHUPS.values())), *poll.OPPONENT_RESULTS]
    other = rated.select(F.col("team").alias("opponent"), "year", "week", taken(F.col("rated"), positions(names, theirs)).alias("theirs"))
    met = rated.join(other, ["opponent", "year", "week"], "left")
    mine = lambda n: F.get("rated", F.lit(names.index(n)))
    his = lambda n: F.get("theirs", F.lit(theirs.index(n)))
    strength = his("cum_win_rate")
    weighted = filled(scaled(F.col("rated"), strength), positions(names, ["win", "loss"]))
    results = scaled(taken(F.col("theirs"), [len(theirs) - len(poll.OPPONENT_RESULTS) + i for i in range(len(poll.OPPONENT_RESULTS))]), strength)
    met = met.withColumn("weighted", F.concat(weighted, F.coalesce(results, F.array_repeat(F.lit(None).cast("double"), len(poll.OPPONENT_RESULTS)))))
    weighted_names = [*[f"w_{n}" for n in names], *[f"w_{n}_opponent" for n in poll.OPPONENT_RESULTS]]
    matched_names = [*[f"m_{n}" for n in poll.MATCHUPS], "m_allowed_plays", "cum_margin_product", "adjusted_win_rate"]
    usual = F.transform(F.array(*[F.lit(theirs.index(t)) for t in poll.MATCHUPS.values()]), lambda i: F.get("theirs", i))
    met = met.withColumn(
        "matched",
        F.concat(
            product(taken(F.col("rated"), positions(names, list(poll.MATCHUPS))), usual),
            F.array(
                mine("allowed_plays") * mine("cum_scoring_plays"), mine("cum_margin") * his("cum_margin"),
                safe_ratio(mine("cum_win") - mine("cum_win_rate") * strength, "games"),
            ),
        ),
    )
    summed = [f"w_{c}" for c in poll.RUNNING_WEIGHTED] + [f"w_{c}_opponent" for c in poll.OPPONENT_RESULTS]
    matched_sums = [f"m_{c}" for c in poll.MATCHUPS] + ["m_allowed_plays"]
    met = met.withColumn("to_sum", F.concat(taken(F.col("weighted"), positions(weighted_names, summed)), taken(F.col("matched"), positions(matched_names, matched_sums))))

    votes = polled.select(*KEYS, F.col("lag_log_votes_opponent").alias("vote"), F.lit(True).alias("polled"))
    seen = met.join(votes, KEYS, "left")
    flags = positions(list(poll.VOTE_WEIGHTED), ["win", "loss"])
    seen = seen.withColumn("voted", filled(scaled(taken(F.col("rated"), positions(names, list(poll.VOTE_WEIGHTED))), F.col("vote")), flags))
    # weeks of teams outside the poll add nothing to the sums of votes
    seen = seen.withColumn("voted", F.when(F.col("polled"), F.col("voted")).otherwise(F.array_repeat(F.lit(None).cast("double"), len(poll.VOTE_WEIGHTED))))
    done = running_vectors(seen, SEASON, ORDER[0], {"w_sums": "to_sum", "v_sums": "voted"}).where("polled").drop("polled", "to_sum", "theirs", "vote")
    sum_names, vote_names = [f"cum_{n}" for n in (*summed, *matched_sums)], [f"v_{n}" for n in poll.VOTE_WEIGHTED]
    done = done.withColumns({"w_means": divided(F.col("w_sums"), F.col("games")), "v_means": divided(F.col("v_sums"), F.col("games"))})
    out = Vectors(
        done,
        {
            "rated": names, "weighted": weighted_names, "matched": matched_names, "w_sums": sum_names, "w_means": [f"{n}_per_game" for n in sum_names],
            "voted": vote_names, "v_sums": [f"cum_{n}" for n in vote_names], "v_means": [f"cum_{n}_per_game" for n in vote_names],
        },
    )
    before = done.withColumns({f"__{f}": out.element(f) for f in poll.LAGGED_FLAGS})
    lags = lagged(SEASON, ORDER, {f"lag_{f}": (f"__{f}", 0.0 if zero_fill_win or f != "win" else None) for f in poll.LAGGED_FLAGS})
    lag_names = [f"lag_{f}" for f in poll.LAGGED_FLAGS]
    frame = before.withColumns(lags).withColumn("lags", packed(lag_names)).drop(*lag_names, *[f"__{f}" for f in poll.LAGGED_FLAGS])
    return Vectors(frame, {**out.names, "lags": lag_names})


def season_vectors(
    plays: DataFrame, votes: DataFrame, order: Sequence[str] = ("game_play_number",), weeks: int = poll.WEEKS, count_null: bool = True, zero_fill_win: bool = True
) -> tuple[Vectors, DataFrame]:
    """Play-by-play and poll votes to the vectors of all features, and the rows of the poll."""
    calendar = store(left_attach(poll.season_calendar(plays, order, weeks, count_null), votes.select(*KEYS, "votes"), KEYS), "calendar")
    polled = store(poll.poll_rows(calendar), "poll-rows")
    return feature_vectors(calendar, polled, zero_fill_win), polled
