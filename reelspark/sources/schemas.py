"""Schemas of catalogue payloads and of the tables the plans take.

Dates stay text, as the payloads have them; ``_links`` and the like are left out.
"""

from __future__ import annotations

from pyspark.sql.types import DataType, StructType

# The field names of the catalogue's payloads.
COUNTRY = "STRUCT<name: STRING, code: STRING, timezone: STRING>"
CHANNEL = f"STRUCT<id: INT, name: STRING, country: {COUNTRY}, officialSite: STRING>"
IMAGE = "STRUCT<medium: STRING, original: STRING>"
SHOW = (
    "STRUCT<id: INT, url: STRING, name: STRING, type: STRING, language: STRING, "
    "genres: ARRAY<STRING>, status: STRING, runtime: INT, averageRuntime: INT, "
    "premiered: STRING, ended: STRING, officialSite: STRING, "
    "schedule: STRUCT<time: STRING, days: ARRAY<STRING>>, rating: STRUCT<average: DOUBLE>, "
    f"weight: INT, network: {CHANNEL}, webChannel: {CHANNEL}, "
    "externals: STRUCT<tvrage: INT, thetvdb: INT, imdb: STRING>, "
    f"image: {IMAGE}, summary: STRING, updated: BIGINT>"
)
SEASON = (
    "STRUCT<id: INT, url: STRING, number: INT, name: STRING, episodeOrder: INT, "
    f"premiereDate: STRING, endDate: STRING, network: {CHANNEL}, webChannel: {CHANNEL}, "
    f"image: {IMAGE}, summary: STRING>"
)
EPISODE = (
    "STRUCT<id: INT, url: STRING, name: STRING, season: INT, number: INT, type: STRING, "
    "airdate: STRING, airtime: STRING, airstamp: STRING, runtime: INT, "
    f"rating: STRUCT<average: DOUBLE>, image: {IMAGE}, summary: STRING>"
)
SEARCH = f"ARRAY<STRUCT<score: DOUBLE, show: {SHOW}>>"

MANIFEST = "path STRING, input_ord BIGINT, path_type STRING"


def table_schema(payload: str, *keys: str) -> StructType:
    """Schema of a table with the fields of a payload, behind key columns of its own."""
    inside = payload[len("STRUCT<") : -1]
    return DataType.fromDDL(f"STRUCT<{', '.join([*keys, inside])}>")
