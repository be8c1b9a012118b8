"""Reference-data joins: shows, seasons, episodes, and the fetch step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import name_key
from reelspark.operators.resolve import attach

NO_SERIES_ID = "no_series_id"
NO_SEASON = "no_season"
NO_EPISODE = "no_episode"
NOT_FOUND = "episode_not_found"
FETCHED = "fetched"


def lookup_error() -> Column:
    """The first reason an episode cannot be looked up, in order; null where it can.

    Season 0 and episode 0 count as missing.
    """
    missing = lambda name: F.coalesce(F.col(name), F.lit(0)) == 0
    return (
        F.when(missing("series_id"), NO_SERIES_ID)
        .when(missing("season"), NO_SEASON)
        .when(missing("episode"), NO_EPISODE)
    )


def join_show(rows: DataFrame, shows: DataFrame) -> DataFrame:
    """Adds the ``show`` of each ``series_id``; rows without one are left out."""
    return rows.join(shows.select(F.col("show_id").alias("series_id"), "show"), "series_id")


def join_show_seasons(rows: DataFrame, seasons: DataFrame) -> DataFrame:
    """One row per season of each ``series_id``."""
    return rows.join(seasons, "series_id")


def season_index(seasons: DataFrame) -> DataFrame:
    """``series_id, season`` to the ID of the first season listed with that number."""
    return seasons.groupBy("series_id", "season").agg(
        F.min(F.struct("ord", "season_id"))["season_id"].alias("season_id")
    )


def season_id(rows: DataFrame, seasons: DataFrame) -> DataFrame:
    """Adds ``season_id``, 0 where the show has no such season."""
    joined = attach(
        rows,
        season_index(seasons),
        {"series_id": F.col("series_id"), "season": F.col("season")},
        ["season_id"],
    )
    return joined.withColumn("season_id", F.coalesce("season_id", F.lit(0)))


def first_or_default(
    rows: DataFrame, key: list[str], order: list[str], value: str, asked: DataFrame | None = None
) -> DataFrame:
    """First value of each key in the given order, 0 where the key has only nulls.

    ``asked`` holds all keys; those without any row get 0 as well.
    """
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(*order, value)))[value]
    found = rows.groupBy(*key).agg(first.alias(value))
    if asked is not None:
        found = asked.select(*key).distinct().join(found, key, "left")
    return found.select(*key, F.coalesce(value, F.lit(0)).alias(value))


def episode_index(episodes: DataFrame) -> DataFrame:
    """Episodes made unique on (series, season, number): the lowest episode ID wins."""
    return (
        episodes.groupBy("series_id", "season", "episode")
        .agg(F.min(F.struct("episode_id", "title", "url", "summary")).alias("_first"))
        .select("series_id", "season", "episode", "_first.*")
    )


def season_episodes(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row per episode of the seasons asked for; ``episode`` gives their order."""
    return rows.join(episodes, ["series_id", "season"])


def episode_title(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds ``fetched_title`` and ``fetch_status``.

    Rows that cannot be looked up get a null key, so they are spread and match nothing.
    """
    error = lookup_error()
    asked = rows.withColumn("fetch_status", error)
    able = F.col("fetch_status").isNull()
    found = attach(
        asked,
        episode_index(episodes).select(
            "series_id", "season", "episode",
            F.coalesce("title", F.lit("")).alias("fetched_title"),
        ),
        {
            "series_id": F.when(able, F.col("series_id")),
            "season": F.when(able, F.col("season")),
            "episode": F.when(able, F.col("episode")),
        },
        ["fetched_title"],
    )
    return found.withColumn(
        "fetch_status",
        F.coalesce(
            "fetch_status",
            F.when(F.col("fetched_title").isNull(), NOT_FOUND).otherwise(F.lit(FETCHED)),
        ),
    )


def join_resolution(rows: DataFrame, resolution: DataFrame, field: str = "series") -> DataFrame:
    """Adds ``series_id`` (0 where unresolved) and ``id_source`` by series name."""
    joined = attach(
        rows, resolution,
        {"series_key": F.nullif(name_key(F.col(field)), F.lit(""))},
        ["series_id", "id_source"],
    )
    return joined.withColumns(
        {
            "series_id": F.coalesce("series_id", F.lit(0)),
            "id_source": F.coalesce("id_source", F.lit("none")),
        }
    )


def enrich(
    rows: DataFrame, resolution: DataFrame, episodes: DataFrame, title_policy: str = "overwrite"
) -> DataFrame:
    """The fetch step: series ID, then the catalogue's episode title.

    ``overwrite`` sets the title to what was fetched, "" where the episode is not in the
    catalogue; ``fill`` keeps the title read off the file name in that case.
    """
    if title_policy not in ("overwrite", "fill"):
        raise ValueError(f"title_policy: {title_policy!r}")
    found = episode_title(join_resolution(rows, resolution), episodes)
    failed = F.col("fetch_status").isin(NO_SERIES_ID, NO_SEASON, NO_EPISODE)
    otherwise = F.lit("") if title_policy == "overwrite" else F.col("title")
    title = F.when(failed, F.col("title")).otherwise(
        F.coalesce("fetched_title", otherwise)
    )
    return found.withColumn("title", title).drop("fetched_title")
