"""Reading metadata off file names with ordered shapes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import paths, text

PARTS = ("series", "year", "season", "episode", "title", "extension")

NO_PATTERNS = "NO_PATTERNS"
NO_MATCH = "NO_MATCH"
MATCHED = "MATCHED"


@dataclass(frozen=True)
class Shape:
    """A file-name layout: a whole-name pattern and what its groups hold, in order."""

    pattern: str
    groups: tuple[str, ...]


# The layouts of episode file names in the order they are tried. The first
# three ignore letter case. "(?U)" gives \d, \w and \s their Unicode meaning and "(?d)"
# makes the line feed the only line end.
_DATED = ("series", "year", "season", "episode", "title", "extension")
_PLAIN = ("series", "season", "episode", "title", "extension")
TV_SHAPES = (
    Shape(r"(?Uid)^(.+?)\.+(\d{4}|\(\d{4}\))?\.*S(\d{2})\.?E(\d{2})\.*(.*)\.+(\w+)\z", _DATED),
    Shape(r"(?Uid)^(.+?)\.+(\d{4}|\(\d{4}\))?\.(\d{1,2})(\d{2})\.*(.*)\.+(\w+)\z", _DATED),
    Shape(r"(?Uid)^(.+)\.+S?(\d+)\.?E?(\d{2,})\.*(.*)\.+(\w+)\z", _PLAIN),
    Shape(r"(?Ud)^(.+)\s+-(\d{2})\.(\d{2})-\s*(.*)\.(.+)\z", _PLAIN),
    Shape(r"(?Ud)^(.+[^\s-])[\s-]+(\d{1,2})(\d{2,})[\s-]+(.*)\.(.+)\z", _PLAIN),
    Shape(r"(?Ud)^(.+)S(\d{1,2})E(\d{2,})(.*)\.(.+)\z", _PLAIN),
)


@dataclass(frozen=True)
class MediaSpec:
    """What a media type is: its shapes and the expressions built on their parts.

    A new type is a new value of this class; nothing in it runs in Python per row.
    """

    section: str
    shapes: tuple[Shape, ...]
    fields: Callable[[dict[str, Column]], dict[str, Column]]
    display: Callable[..., Column]
    folder: Callable[..., Column]


def tv_fields(parts: dict[str, Column]) -> dict[str, Column]:
    """Typed episode fields of the raw parts; "" and 0 stand for "not known"."""
    return {
        "series": text.normalize_series(F.coalesce(parts["series"], F.lit(""))),
        "season": text.whole_number(parts["season"]),
        "episode": text.whole_number(parts["episode"]),
        "title": text.normalize_title(F.coalesce(parts["title"], F.lit(""))),
    }


TV = MediaSpec("tv", TV_SHAPES, tv_fields, paths.display_name, paths.target_dir)


def _alternative(shape: Shape) -> str | None:
    """The pattern as one alternative among others; None where it has to stand alone.

    It must be anchored at both ends, have the groups named and no reference to one, and begin with
    a group that is never empty.
    """
    whole = re.fullmatch(r"\(\?([Uidsu]+)\)\^(\(\.\+.*)\\z", shape.pattern)
    if whole is None or re.search(r"\\[1-9kQ]|\(\?", whole[2]):
        return None
    inner, found = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", whole[2]), 1
    groups = inner.count("(")
    while found:
        inner, found = re.subn(r"\([^()]*\)", "", inner)
    return f"(?{whole[1]}:{whole[2]}\\z)" if groups == len(shape.groups) and "|" not in inner else None


def match_shapes(files: DataFrame, shapes: tuple[Shape, ...], path: str = "path") -> DataFrame:
    """Adds ``_pieces``: marked parts of the first shape the base name fits, behind a piece per shape.

    Of the latter, the first that is not empty tells the shape. Shapes are alternatives of one pattern, tried in
    order by one replacement. Where some shape cannot be (a reference to a group, say), there is a
    replacement per shape: a rewritten name starts with the mark, at which every later pattern gives up
    at once. Each step uses the one before exactly once, so the expression stays linear wherever
    Catalyst moves it.
    """
    mark = text.MARK
    name = F.replace(paths.base_name(F.col(path)), F.lit(mark), F.lit("\ufffd"))
    alternatives = [_alternative(shape) for shape in shapes]
    if shapes and None not in alternatives:
        first, firsts, slots = 1, [], {part: "" for part in PARTS}
        for shape in shapes:
            firsts.append(f"${first}")
            for group, part in enumerate(shape.groups, start=first):
                slots[part] += f"${group}"
            first += len(shape.groups)
        marked = "".join(mark + piece for piece in (*firsts, *slots.values()))
        name = F.regexp_replace(name, f"^(?:{'|'.join(alternatives)})", marked)
        return files.withColumn("_pieces", F.split(name, mark))
    for number, shape in enumerate(shapes, start=1):
        parts = "".join(
            mark + (f"${shape.groups.index(part) + 1}" if part in shape.groups else "")
            for part in PARTS
        )
        which = "".join(mark + "x" * (n == number) for n in range(1, len(shapes) + 1))
        pattern = shape.pattern.replace(")^", f")^(?!{mark})", 1)
        name = F.regexp_replace(name, pattern, which + parts)
    return files.withColumn("_pieces", F.split(name, mark))


def infer(files: DataFrame, spec: MediaSpec = TV, path: str = "path") -> DataFrame:
    """Adds ``parts`` (null where nothing fits), the fields of the media type, ``infer_status``."""
    matched = match_shapes(files, spec.shapes, path)
    missing = NO_MATCH if spec.shapes else NO_PATTERNS
    return matched.withColumns(
        {
            "parts": _named_parts(spec),
            **spec.fields(_raw_parts(spec)),
            "infer_status": F.when(F.size("_pieces") > 1, MATCHED).otherwise(missing),
        }
    ).drop("_pieces")


def with_parts(files: DataFrame, spec: MediaSpec = TV, path: str = "path") -> DataFrame:
    """Adds ``parts`` alone, as ``infer`` does."""
    return match_shapes(files, spec.shapes, path).withColumn("parts", _named_parts(spec)).drop("_pieces")


def _raw_parts(spec: MediaSpec) -> dict[str, Column]:
    return {part: F.get("_pieces", F.lit(i)) for i, part in enumerate(PARTS, start=len(spec.shapes) + 1)}


def _named_parts(spec: MediaSpec) -> Column:
    """The shape that fits, by number, and its parts; null where none does."""
    pieces = F.col("_pieces")
    shape = F.coalesce(*(F.when(F.get(pieces, F.lit(n)) != "", n) for n in range(1, len(spec.shapes) + 1)), F.lit(None).cast("int"))
    named = F.struct(shape.alias("shape"), *(value.alias(part) for part, value in _raw_parts(spec).items()))
    return F.when(F.size(pieces) > 1, named)


def unmatched(inferred: DataFrame) -> DataFrame:
    """The files no shape fits, or whose type has no shapes."""
    return inferred.filter(F.col("infer_status") != MATCHED)


def metadata_struct() -> Column:
    """The four public fields of an episode."""
    return F.struct("series", "season", "episode", "title")
