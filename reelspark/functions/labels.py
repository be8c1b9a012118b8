"""Text lines about shows, episodes and search candidates, and request addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspark.functions.html import strip_tags
from reelspark.functions.text import url_quote

UNKNOWN = "Unknown"


def network_name(show: Column) -> Column:
    """Broadcast network, else web channel, else "Unknown"."""
    return F.coalesce(show["network"]["name"], show["webChannel"]["name"], F.lit(UNKNOWN))


def network_country(show: Column) -> Column:
    """Country of the channel that :func:`network_name` names; "Unknown" where it has none."""
    country = (
        F.when(show["network"]["name"].isNotNull(), show["network"]["country"]["name"])
        .when(show["webChannel"]["name"].isNotNull(), show["webChannel"]["country"]["name"])
    )
    return F.coalesce(country, F.lit(UNKNOWN))


def candidate_label(number: Column, show: Column) -> Column:
    """``n. Name (Premiered: …, Network: …, Country: …, ID: …)``.

    A result without a show gives "Unknown" and ID 0; a show whose premiere is not known
    prints None.
    """
    known = show["id"].isNotNull()
    told = lambda part: F.when(known, _shown(show[part])).otherwise(F.lit(UNKNOWN))
    return F.concat(
        number.cast("string"), F.lit(". "), told("name"),
        F.lit(" (Premiered: "), told("premiered"),
        F.lit(", Network: "), network_name(show),
        F.lit(", Country: "), network_country(show),
        F.lit(", ID: "), F.coalesce(show["id"], F.lit(0)).cast("string"), F.lit(")"),
    )


def _shown(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("None"))


def series_text(show: Column) -> Column:
    """Three lines: name, ID, address; premiere and status; summary (empty where null)."""
    return F.concat(
        _shown(show["name"]), F.lit(" - ID: "), _shown(show["id"]), F.lit(" - "), _shown(show["url"]),
        F.lit("\nPremiered: "), _shown(show["premiered"]), F.lit(" - Status: "), _shown(show["status"]),
        F.lit("\n"), F.coalesce(strip_tags(show["summary"]), F.lit("")),
    )


def episode_text(season: Column, number: Column, name: Column, url: Column, summary: Column) -> Column:
    """Three lines: ``SxN - Name``; address; summary (empty where null)."""
    return F.concat(
        _shown(season), F.lit("x"), _shown(number), F.lit(" - "), _shown(name),
        F.lit("\n"), _shown(url),
        F.lit("\n"), F.coalesce(strip_tags(summary), F.lit("")),
    )


def lookup_urls(
    service: str, series: Column, series_id: Column, season: Column, episode: Column, season_id: Column
) -> dict[str, Column]:
    """The request addresses of a catalogue service, by kind of question."""
    root = F.lit(service)
    show = F.concat(root, F.lit("/shows/"), series_id.cast("string"))
    return {
        "search_url": F.concat(root, F.lit("/search/shows/?q="), url_quote(series)),
        "single_search_url": F.concat(root, F.lit("/singlesearch/shows/?q="), url_quote(series)),
        "episode_url": F.concat(
            show, F.lit("/episodebynumber?season="), season.cast("string"),
            F.lit("&number="), episode.cast("string"),
        ),
        "season_episodes_url": F.concat(
            root, F.lit("/seasons/"), season_id.cast("string"), F.lit("/episodes")
        ),
        "show_url": show,
        "show_seasons_url": F.concat(show, F.lit("/seasons")),
    }
