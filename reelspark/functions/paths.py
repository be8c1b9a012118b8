"""Path arithmetic and the canonical name and directory of an episode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)


def suffix(name: Column) -> Column:
    """The last dot and what follows it, if anything does and something comes before."""
    tail = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    inside = (F.length(tail) < F.length(name)) & (tail != ".")
    return F.when(inside, tail).otherwise("")


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def in_folder(folder: Column, name: Column) -> Column:
    """``folder/name``, or just the name where the folder is empty."""
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def or_unknown(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Unknown"))


def display_name(series: Column, season: Column, episode: Column, title: Column) -> Column:
    """``Series -SS.EE- Title``; numbers are padded to two digits and never cut."""
    return F.format_string(
        "%s -%02d.%02d- %s", or_unknown(series), season, episode, or_unknown(title)
    )


def is_one_name(name: Column) -> Column:
    """Can it name one file or folder? A slash would make it a path."""
    return ~F.coalesce(F.contains(name, F.lit("/")), F.lit(False))


def target_dir(library: Column, series: Column, season: Column) -> Column:
    """``library/Series/Season SS``; null for a series with a slash in it."""
    return F.when(is_one_name(series), F.format_string("%s/%s/Season %02d", library, series, season))


def rename_target(path: Column, display: Column) -> Column:
    """The display name in the same folder, with the old suffix; null for a name with a slash in it."""
    name = F.concat(display, suffix(base_name(path)))
    return F.when(is_one_name(display), in_folder(parent(path), name))
