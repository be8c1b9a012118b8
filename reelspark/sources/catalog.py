"""Catalogue snapshots: shows, seasons, episodes and search results."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.sources import schemas


class Catalog(Protocol):
    """Any source of metadata: three tables, keyed as below.

    ``shows``: show_id, name and the ``show`` struct. ``seasons``: series_id, ord, season_id,
    season. ``episodes``: series_id, season, episode, episode_id, title, url, summary.
    """

    def shows(self) -> DataFrame: ...

    def seasons(self) -> DataFrame: ...

    def episodes(self) -> DataFrame: ...


class RawCatalog(Protocol):
    """A catalogue that still has its records as they came, column ``text``, beside their keys.

    ``raw_shows``: show_id, text. ``raw_episodes``: series_id, season, episode, episode_id, text.
    """

    def raw_shows(self) -> DataFrame: ...

    def raw_episodes(self) -> DataFrame: ...


@dataclass(frozen=True)
class TableCatalog:
    """A catalogue whose tables are at hand already."""

    show_table: DataFrame
    season_table: DataFrame
    episode_table: DataFrame

    def shows(self) -> DataFrame:
        return self.show_table

    def seasons(self) -> DataFrame:
        return self.season_table

    def episodes(self) -> DataFrame:
        return self.episode_table


@dataclass(frozen=True)
class PayloadCatalog:
    """A catalogue of JSON payloads: a show or an episode per row, an array of seasons per series."""

    show_payloads: DataFrame
    season_payloads: DataFrame
    episode_payloads: DataFrame

    def shows(self) -> DataFrame:
        return parse_shows(self.show_payloads)

    def seasons(self) -> DataFrame:
        return parse_seasons(self.season_payloads)

    def episodes(self) -> DataFrame:
        return parse_episodes(self.episode_payloads)

    def raw_shows(self) -> DataFrame:
        return raw_shows(self.show_payloads)

    def raw_episodes(self) -> DataFrame:
        return raw_episodes(self.episode_payloads)


@dataclass(frozen=True)
class JsonCatalog:
    """A snapshot as JSON lines: folders ``shows``, ``seasons`` and ``episodes`` under a root.

    Season and episode lines carry ``series_id`` beside the payload's own fields. Spark reads
    only the columns a plan uses, with a fixed schema instead of a pass to infer one.
    """

    spark: SparkSession
    root: str

    def _lines(self, name: str, payload: str, *keys: str) -> DataFrame:
        schema = schemas.table_schema(payload, *keys)
        return self.spark.read.schema(schema).json(f"{self.root}/{name}")

    def shows(self) -> DataFrame:
        return show_columns(self._lines("shows", schemas.SHOW).select(F.struct("*").alias("show")))

    def seasons(self) -> DataFrame:
        lines = self._lines("seasons", schemas.SEASON, "series_id: INT", "ord: INT")
        fields = [f for f in lines.columns if f not in ("series_id", "ord")]
        return season_columns(lines.select("series_id", "ord", F.struct(*fields).alias("item")))

    def episodes(self) -> DataFrame:
        lines = self._lines("episodes", schemas.EPISODE, "series_id: INT")
        fields = [f for f in lines.columns if f != "series_id"]
        return episode_columns(lines.select("series_id", F.struct(*fields).alias("item")))

    def raw_shows(self) -> DataFrame:
        return raw_shows(self.spark.read.text(f"{self.root}/shows"), "value")

    def raw_episodes(self) -> DataFrame:
        """Lines as they are, with the ``series_id`` that the snapshot adds."""
        series = F.get_json_object("value", "$.series_id").try_cast("int").alias("series_id")
        return raw_episodes(self.spark.read.text(f"{self.root}/episodes").select(series, "value"), "value")


def show_columns(shows: DataFrame) -> DataFrame:
    """Key and name beside the ``show`` struct."""
    return shows.select(F.col("show.id").alias("show_id"), F.col("show.name").alias("name"), "show")


def parse_shows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One JSON object per row to the ``shows`` table."""
    return show_columns(payloads.select(F.from_json(payload, schemas.SHOW).alias("show")))


def season_columns(items: DataFrame) -> DataFrame:
    item = F.col("item")
    return items.select(
        "series_id", "ord",
        item["id"].alias("season_id"), item["number"].alias("season"),
        item["name"].alias("name"), item["episodeOrder"].alias("episode_order"),
        item["premiereDate"].alias("premiere_date"), item["endDate"].alias("end_date"),
        item["url"].alias("url"), item["network"].alias("network"), item["webChannel"].alias("web_channel"),
        item["image"].alias("image"), item["summary"].alias("summary"),
    )


def parse_seasons(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One JSON array per ``series_id`` to the ``seasons`` table; ``ord`` keeps its order."""
    return season_columns(
        payloads.select(
            "series_id",
            F.posexplode(F.from_json(payload, f"ARRAY<{schemas.SEASON}>")).alias("ord", "item"),
        )
    )


def episode_columns(items: DataFrame) -> DataFrame:
    """Fields of an episode, with the air date and air time also as DATE and TIMESTAMP."""
    item = F.col("item")
    return items.select(
        "series_id",
        item["season"].alias("season"), item["number"].alias("episode"),
        item["id"].alias("episode_id"), item["name"].alias("title"), item["url"].alias("url"),
        item["summary"].alias("summary"), item["airdate"].alias("airdate"),
        item["airdate"].try_cast("date").alias("air_date"),
        item["airstamp"].try_cast("timestamp").alias("air_time"),
    )


def parse_episodes(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One JSON object per row, beside its ``series_id``, to the ``episodes`` table."""
    return episode_columns(
        payloads.select("series_id", F.from_json(payload, schemas.EPISODE).alias("item"))
    )


def parse_search_results(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Search payloads to one row per candidate: ``query, number, score, show``.

    The array's order is the service's ranking; ``number`` is the 1-based option number. An
    empty array gives no rows.
    """
    return payloads.select(
        "query", F.posexplode(F.from_json(payload, schemas.SEARCH)).alias("pos", "hit")
    ).select(
        "query",
        (F.col("pos") + 1).cast("bigint").alias("number"),
        F.col("hit.score").alias("score"),
        F.col("hit.show").alias("show"),
    )


def raw_shows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Show records as they came, one JSON object per row, beside their ID."""
    return payloads.select(
        F.get_json_object(payload, "$.id").try_cast("int").alias("show_id"), F.col(payload).alias("text")
    )


def raw_episodes(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Episode records as they came, beside what they are looked up by.

    ``payloads``: series_id, payload (one JSON record).
    """
    number = lambda field: F.get_json_object(payload, f"$.{field}").try_cast("int")
    return payloads.select(
        "series_id", number("season").alias("season"), number("number").alias("episode"),
        number("id").alias("episode_id"), F.col(payload).alias("text"),
    )
