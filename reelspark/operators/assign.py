"""Giving known episodes to files: one file by number, or many files by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import paths
from reelspark.operators.enrich import FETCHED, NOT_FOUND, episode_title
from reelspark.operators.ordinals import number_rows
from reelspark.operators.resolve import attach


def natural_key(name: Column) -> list[Column]:
    """Files in numeric order of the number they begin with, however long, then by name."""
    digits = F.regexp_replace(F.regexp_extract(name, "^[0-9]+", 0), "^0+", "")
    return [F.length(digits), digits, name]


def number_naturally(rows: DataFrame, filename: Column, within: list[str], name: str) -> DataFrame:
    """Adds the 1-based position of each row in natural order of its file name, then by path.

    The keys are columns of the rows that are sorted: as expressions they would be worked out anew for
    every comparison.
    """
    length, digits, whole = natural_key(filename)
    keys = {"_natural_length": length, "_natural_digits": digits, "_natural_name": whole}
    numbered = number_rows(rows.withColumns(keys), [*map(F.col, keys), F.col("path")], within, name)
    return numbered.drop(*keys)


def order_key() -> list[Column]:
    """Ordering of episode records as such: path first, then the fields."""
    return [F.col(c) for c in ("path", "series", "series_id", "season", "episode", "title")]


def given(column: str) -> Column:
    """Is an optional argument set? "" and 0 count as not set."""
    value = F.col(column)
    return F.coalesce(value.cast("string"), F.lit("")).isin("", "0") == F.lit(False)


def lookup_reason() -> Column:
    """Why a lookup request is refused, null where it is fine."""
    return (
        F.when(given("series") & given("series_id"), "series_and_series_id")
        .when(~given("series") & ~given("series_id"), "no_series")
        .when(given("episode") & ~given("season"), "episode_without_season")
    )


def assignment_reason() -> Column:
    """Why an assignment is refused; one episode goes to exactly one file."""
    return (
        F.when(~given("series"), "no_series")
        .when(given("episode") & ~given("season"), "episode_without_season")
        .when(given("episode") & (F.col("n_files") != 1), "not_one_file")
    )


def file_counts(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``n_files``; files are counted before they are shuffled."""
    counts = files.groupBy("request_id").agg(F.count("*").alias("n_files"))
    return requests.join(counts, "request_id", "left").withColumn(
        "n_files", F.coalesce("n_files", F.lit(0).cast("bigint"))
    )


def apply_single(files: DataFrame, requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """Assignments of one episode to one file. The series is used as given.

    ``requests``: accepted ones with series, series_id, season, episode.
    """
    wanted = ["series", "series_id", "season", "episode"]
    chosen = attach(
        files, requests.filter(given("episode")), {"request_id": F.col("request_id")}, wanted, "inner"
    )
    titled = episode_title(chosen, episodes)
    known = F.col("fetch_status").isin(FETCHED, NOT_FOUND)
    title = F.when(known, F.coalesce("fetched_title", F.lit("")))
    return _renamed(titled.withColumn("title", title), known, F.col("fetch_status"))


def apply_ordinals(files: DataFrame) -> DataFrame:
    """Position of each file in its request, in natural order."""
    return number_naturally(files, paths.base_name(F.col("path")), ["request_id"], "idx")


def episode_ordinals(episodes: DataFrame) -> DataFrame:
    """Position of each episode in its season."""
    order = [F.col("episode"), F.col("episode_id")]
    return number_rows(episodes, order, ["series_id", "season"], "idx")


def apply_season(files: DataFrame, requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """The i-th file of a request gets the i-th episode of its season.

    A file beyond the last episode keeps its row, without a target, as ``no_episode_left``. Both sides are numbered first and meet on (series, season, position), a key that is
    unique on the episode side: no list is paired with another inside one task.
    """
    wanted = ["series", "series_id", "season"]
    chosen = attach(
        files, requests.filter(~given("episode")), {"request_id": F.col("request_id")}, wanted, "inner"
    )
    placed = apply_ordinals(chosen)
    listed = episode_ordinals(
        episodes.select("series_id", "season", "episode", "episode_id", "title")
    )
    paired = placed.join(listed, ["series_id", "season", "idx"], "left")
    found = F.col("episode_id").isNotNull()
    title = F.when(found, F.coalesce("title", F.lit("")))
    status = F.when(found, "paired").otherwise("no_episode_left")
    return _renamed(paired.withColumn("title", title), found, status)


def _renamed(rows: DataFrame, done: Column, status: Column) -> DataFrame:
    display = paths.display_name(
        F.col("series"), F.col("season"), F.col("episode"), F.col("title")
    )
    return rows.select(
        "request_id", "path", "series", "series_id", "season", "episode", "title",
        F.when(done, paths.rename_target(F.col("path"), display)).alias("rename_target"),
        status.alias("status"),
    )
