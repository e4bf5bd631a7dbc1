"""Listening history: export rows to a clean table, then rollups, leaders and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_parts, parse_utc, up_to_last_year
from ..functions.nulls import differs_or_null
from ..functions.numeric import duration_chain
from ..operators.aggregates import distinct_per_group, value_at_first
from ..operators.joins import keep_matching
from ..operators.ranking import first_per_key, top_n
from ..operators.windows import running_totals

# Column names of the export and what they are called here, and the row filter: fixed values
EXPORT_COLUMNS = {
    "ts": "ts",
    "ms_played": "ms_played",
    "master_metadata_track_name": "track_name",
    "master_metadata_album_artist_name": "artist",
    "master_metadata_album_album_name": "album",
    "reason_start": "reason_start",
    "reason_end": "reason_end",
    "shuffle": "shuffle",
    "skipped": "skipped",
    "episode_show_name": "show",
}
SONG, SPOKEN = "song", "show/podcast/book"
NOISE_ARTIST = "Pink Noise"
FIRST_YEAR = 2014


def clean_history(export: DataFrame) -> DataFrame:
    """Rename, drop rows with neither track nor show, add type, calendar parts and durations."""
    rows = export.select(*[F.col(c).alias(n) for c, n in EXPORT_COLUMNS.items()])
    rows = rows.dropna(how="all", subset=["track_name", "show"])
    rows = rows.withColumn("at", parse_utc("ts"))
    return rows.withColumns(
        {
            "type": F.when(F.col("track_name").isNull(), SPOKEN).otherwise(SONG),
            **calendar_parts("at"),
            "seconds": F.col("ms_played") / 1000,
            "mins": F.col("ms_played") / 60000,
        }
    )


def analysis_rows(history: DataFrame, reference_date: str, tie: Sequence[str] = ("track_name", "artist", "ms_played")) -> DataFrame:
    """Whole past years, no noise, nothing unplayed, one row per timestamp."""
    kept = history.where(
        (F.col("year") >= FIRST_YEAR)
        & differs_or_null("artist", NOISE_ARTIST)
        & up_to_last_year("at", reference_date)
        & (F.col("ms_played") != 0)
    )
    return first_per_key(kept, ["ts"], list(tie)).withColumn("hours", F.col("ms_played") / 3600000)


def time_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Listening time per key in all units, and the number of plays."""
    sums = rows.groupBy(*keys).agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.count(F.lit(1)).alias("plays"))
    units = [c.alias(n) for n, c in duration_chain("seconds").items()]
    return sums.select(*keys, "seconds", *units, "plays")


def leaders(rows: DataFrame, entity: Sequence[str], n: int, period: Sequence[str] = ()) -> DataFrame:
    """The n most played songs, albums or artists, per period if asked, ties kept."""
    songs = rows.where(F.col("type") == SONG)
    return top_n(time_by(songs, [*period, *entity]), n, [F.desc("seconds")], period)


def labelled_leaders(rows: DataFrame, entity: str, n: int) -> DataFrame:
    """Leaders with the artist of their first play."""
    songs = rows.where(F.col("type") == SONG)
    first = songs.groupBy(entity).agg(value_at_first("artist", ["ts", "track_name", "artist"]).alias("artist"))
    top = leaders(rows, [entity], n)
    return top.join(first, entity).withColumn("label", F.concat(entity, F.lit(", "), F.coalesce("artist", F.lit("NA"))))


def variety(rows: DataFrame, entity: str, period: str = "year") -> DataFrame:
    songs = rows.where(F.col("type") == SONG)
    return distinct_per_group(songs, [period], entity, "distinct_count")


def drilldown(rows: DataFrame, top: DataFrame, keys: Sequence[str], finer: Sequence[str]) -> DataFrame:
    """Time of the leaders only, by a finer period."""
    songs = rows.where(F.col("type") == SONG)
    return time_by(keep_matching(songs, top, keys), [*dict.fromkeys([*keys, *finer])])


def cumulative_leaders(rows: DataFrame, entity: str = "artist", n: int = 10, period: str = "month_year") -> DataFrame:
    """Running hours of the n all-time leaders."""
    monthly = drilldown(rows, leaders(rows, [entity], n), [entity], [period])
    run = running_totals(monthly, [entity], [period], {"__t": "seconds"})
    return run.select(entity, period, "seconds", (F.round("__t", 6) / 3600).alias("total_hours"))
