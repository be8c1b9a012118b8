"""Quality rules on repetition: which share of a text's characters lies in repeated n-grams and lines.

Words become 64-bit hashes, n-grams rolling hashes over them, and each length marks the words that
its repeated n-grams cover. The base counts are exact: their windows compare word numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Shares of the characters in words; a text over any of them is rejected.

    top: the most frequent n-gram of that length. repeated: all n-grams that occur a second time.
    Only later copies count, so what the base rule lets pass has a share of 0.25 at most in two copies and
    of 0.4 in five. The limits on repeated n-grams are the usual ones. A passage quoted twice is a great part of a
    short text, so `quote` words more are allowed, as a share of the text's words and at most 0.05.
    """

    lines: float = 0.2
    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    repeated: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    quote: int = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of the words lie in one of the n-grams that begin at starts."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _numbers(tokens: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(t, len(known)) for t in tokens], np.int64)


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per place: does the key occur twice or more; is it a later one; how often it occurs."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    times = counts[inverse]
    return times > 1, first[inverse] != np.arange(len(keys)), times


def measure(text: str | None, limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, worst."""
    text = text or ""
    raw = text.encode()
    tokens = raw.split()
    n = len(tokens)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup_lines, dup_chars = 0, 0
    for line in lines:
        if line.strip():
            if line in seen:
                dup_lines += 1
                dup_chars += sum(map(len, line.split()))
            else:
                seen.add(line)
    ids = _numbers(tokens)
    repeat_words, worst = 0, 0.0
    if n >= 3:
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        again = _twice(pair[:-1] * n + ids[2:])[0]
        repeat_words = int(_covered(np.nonzero(again)[0], 3, n).sum()) if again.any() else 0
    failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    if not failed:
        size = np.fromiter(map(len, tokens), np.int64, n)
        total = int(size.sum())
        allowed = min(0.05, limits.quote / n)
        ends = np.concatenate(([0], np.cumsum(size)))
        worst = float(dup_chars / total / limits.lines)
        word = _mix((ids + 1).astype(np.uint64) * _ODD)
        rolled = word.copy()
        for k in range(2, max([1, *limits.top, *limits.repeated]) + 1):
            if k > n:
                break
            rolled = _mix(rolled[: n - k + 1] * np.uint64(31)) + word[k - 1 :]
            if k not in limits.top and k not in limits.repeated:
                continue
            twice, later, times = _twice(rolled)
            if not twice.any():
                break  # no longer n-gram can repeat
            if k in limits.top:
                most = np.where(times == times.max(), times * (ends[k:] - ends[:-k]), 0).max()
                worst = max(worst, float(most) / total / limits.top[k])
            if k in limits.repeated:
                share = float(size[_covered(np.nonzero(later)[0], k, n)].sum()) / total
                worst = max(worst, share / (limits.repeated[k] + allowed))
    return n, word_chars, symbols, dup_lines, repeat_words, failed, not failed and worst <= 1.0, float(worst)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repetition")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, repetition double"
)


def _measured(limits: Limits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measure(t, limits) for t in batch["text"]], columns=NAMES)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return run


def repetition(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row per row of docs: the counts, base_failed, kept and the worst share over its limit.

    A null text counts as empty and fails the base rule, as does any text under 50 words.
    Repeated rows give a row each; a null doc_id stays null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_measured(limits or Limits()), SCHEMA)


def good_docs(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of docs that are kept, with their columns; rows without doc_id are rejected."""
    limits = limits or Limits()

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(t, limits)[6] for t in texts])

    return docs.where("doc_id is not null").where(kept("text"))
