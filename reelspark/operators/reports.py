"""Text reports about shows, seasons and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.labels import episode_text, series_text
from reelspark.operators.assign import episode_ordinals
from reelspark.operators.enrich import episode_index

def series_report(shows: DataFrame) -> DataFrame:
    return shows.select(F.col("show_id").alias("series_id"), series_text(F.col("show")).alias("text"))


def _episode_text():
    return episode_text(*map(F.col, ("season", "episode", "title", "url", "summary")))


def episode_report(episodes: DataFrame) -> DataFrame:
    """One text per episode; of several with one number, the lowest ID speaks."""
    return episode_index(episodes).select(
        "series_id", "season", "episode", _episode_text().alias("text")
    )


def season_report(episodes: DataFrame) -> DataFrame:
    """The episode texts of each season, one row per episode; ``idx`` gives their order."""
    return episode_ordinals(episodes).select("series_id", "season", "idx", _episode_text().alias("text"))


def raw_episode_report(records: DataFrame) -> DataFrame:
    """One record per episode, as it came; of several with one number, that with the lowest ID."""
    return (
        records.groupBy("series_id", "season", "episode")
        .agg(F.min(F.struct("episode_id", "text"))["text"].alias("text"))
    )


def raw_season_report(records: DataFrame) -> DataFrame:
    """The records of each season, as they came, one row per episode; ``idx`` gives their order."""
    return episode_ordinals(records).select("series_id", "season", "idx", "text")


def season_text(episodes: DataFrame) -> DataFrame:
    """A season as one text, a blank line between episodes: for readers who want one row per season."""
    lines = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return (
        season_report(episodes)
        .groupBy("series_id", "season")
        .agg(lines.alias("_lines"))
        .select("series_id", "season", F.array_join("_lines.text", "\n\n").alias("text"))
    )
