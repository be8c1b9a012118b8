"""Text clean-up as column expressions; everything stays in generated JVM code."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The release tags a title is cut at, in any letter case.
RELEASE_TAGS = ("1080p", "720p", "HDTV", "WEB", "PROPER", "REPACK", "RERIP")

# A mark that valid text never holds (a Unicode noncharacter).
MARK = "﷐"


@cache
def _whitespace() -> str:
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


@cache
def _digits() -> tuple[str, str]:
    other = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(other), "".join(str(unicodedata.digit(c)) for c in other)


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not just blanks."""
    return F.btrim(text, F.lit(_whitespace()))


def undot(text: Column) -> Column:
    """Dots to blanks, then trimmed."""
    return strip(F.replace(text, F.lit("."), F.lit(" ")))


def title_case(text: Column) -> Column:
    """A capital after *any* character that has no case: "marvel's" gives "Marvel'S".

    ``initcap`` only looks at blanks, so a marked blank is put wherever a word starts after
    another character without case, and taken out again; that keeps the expression inside
    whole-stage code generation, which a lambda over an array of words would not.
    """
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    starts = F.regexp_replace(F.lower(text), rf"([^{cased} ])(?=[{cased}])", f"$1{MARK} ")
    return F.replace(F.initcap(starts), F.lit(f"{MARK} "), F.lit(""))


def cap_words(text: Column) -> Column:
    """One blank between words, each word capitalised: "devil's  lamp" gives "Devil's Lamp"."""
    return F.initcap(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def strip_release_tags(text: Column, strict: bool = False) -> Column:
    """Cut from the first release tag (or its opening parenthesis) to the end of the line.

    A tag inside a word counts too ("The Web Below" becomes "The"); ``strict`` asks for
    word boundaries around the tag.
    """
    tags = "|".join(RELEASE_TAGS)
    first = "".join(sorted({tag[0] for tag in RELEASE_TAGS}))
    edge = r"\b" if strict else ""
    # The look-ahead only lets the search skip characters that start no tag.
    return F.regexp_replace(text, rf"(?iud)(?=[({first}])\(?{edge}(?:{tags}){edge}.*", "")


def whole_number(text: Column) -> Column:
    """Digits to BIGINT, 0 where there are none; digits of other scripts count as well."""
    other, ascii_ = _digits()
    latin = F.when(text.rlike("[^0-9]"), F.translate(text, other, ascii_)).otherwise(text)
    return F.coalesce(latin.try_cast("bigint"), F.lit(0).cast("bigint"))


def normalize_series(text: Column) -> Column:
    return title_case(undot(text))


def normalize_title(text: Column, strict_tags: bool = False) -> Column:
    return cap_words(strip_release_tags(undot(text), strict_tags))


def name_key(text: Column) -> Column:
    """Key of case-insensitive lookups: letter case and outer blanks do not count."""
    return F.lower(strip(text))


def search_key(text: Column) -> Column:
    """Key of free-text search: lower-case words of letters and digits, one blank between."""
    plain = F.translate(F.lower(text), "'’", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def url_quote(text: Column) -> Column:
    """Percent-encode a query, blanks as "+" (two characters differ from Java's encoder)."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
