"""Packing of tokenised documents into windows of several lengths.

A document of more tokens than the longest window gives whole windows and one rest; a rest, or a
shorter document, is routed to the shortest tier that holds it. Each tier is packed into windows of its
own size, longest first; the gap of a window is filled from shorter tiers. As every tier is a power of
two, a full window needs no padding, whatever its tier. What a tier cannot fill without a cut is cut.

Only the histogram of lengths (one number per length) is looked at as a whole. The plan is made of
patterns, each repeated as often as the histogram allows, so its size and its cost do not grow with
the documents. A piece finds its place by its rank within its length.

The windows are dealt out to step groups of about the same number of tokens, with each tier in proportion.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import written

TIERS = (4096, 2048, 1024, 512, 256)
STEP_TOKENS = 1 << 18
TOKENIZER, CLOSING = "word_bpe_49k", 2
PIECES = "doc_id long, doc_tokens long, start long, length long, part int, k long, ids binary"
PLACED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window int, step_group long"
)


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Characters this Python's tables do not know, though those of the tokenizer's library may."""
    gone = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    edges = [c for i, c in enumerate(gone) if not i or gone[i - 1] != c - 1], [c for c, d in zip(gone, [*gone[1:], -1]) if d != c + 1]
    return re.compile("[" + "".join(f"{re.escape(chr(lo))}-{re.escape(chr(hi))}" for lo, hi in zip(*edges)) + "]")


class Encoder:
    """Ids of texts under the vocabulary of a tokenizer file with word ends and lower case.

    The file's library works out every word anew and needs three times as long as a faster encoder with the same
    vocabulary: words are found by the same pattern, and a mark at the end of each stands for the end of a
    word, so that it is merged first and merges go on in the file's order. Texts with that mark in them,
    with special tokens, with characters that are not composed or unknown here go through the library.
    """

    END, MARK = "</w>", "\0"
    # Fixed value: the file's own pattern of words, after lower-casing.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.words = regex.compile(self.WORDS)
        self.special = [found.content for found in self.full.get_added_tokens_decoder().values()]
        # The usual alphabet of bytes: visible ones stand for themselves, the others for what follows the first 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.odd = [self.MARK, *self.special]
        ranks, numbers, mark = {}, [], self.MARK.encode()
        for token, number in sorted(self.full.get_vocab().items(), key=lambda item: item[1]):
            body = token.removesuffix(self.END)
            raw = bytes(alphabet.get(c, 0) for c in body)
            if token not in self.special and mark not in raw:
                ranks[raw + (mark if body != token else b"")] = len(numbers)
                numbers.append(number)
        ranks[mark] = len(numbers)
        self.numbers = np.array([*numbers, -1], np.int64)
        self.fast = tiktoken.Encoding(name, pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        plain = not any(s in text for s in self.odd)
        if plain and not text.isascii():
            plain = unicodedata.is_normalized("NFC", text) and not _unassigned().search("".join(set(text)))
        if not plain:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.int64)
        # One letter has another lower case at the end of a word; the file's rule goes by letters alone.
        words = self.words.findall(text.replace("\u03a3", "\u03c3").lower())
        words.append("")  # so that the last word has its mark
        return self.numbers[self.fast.encode_ordinary(self.MARK.join(words))]


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def routed(n: int, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows of the longest tier, then the rest."""
    longest = tiers[0]
    return [(a, min(longest, n - a)) for a in range(0, n, longest)]


def _pieces(tiers: tuple[int, ...], name: str, closing: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(tiers[0] + 1, np.int64), encoder(name)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode.ids(text), closing)
                small = ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")
                for start, length in routed(len(ids), tiers):
                    rows.append((doc_id, len(ids), start, length, part, int(seen[length]), small[start : start + length].tobytes()))
                    seen[length] += 1
            frame = pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "start", "length", "part", "k", "ids"])
            yield frame.astype({"doc_id": "Int64"})

    return run


class Stock:
    """Pieces still to be packed, by length: stretches (original length, from, to, first rank, count) of equal slices."""

    def __init__(self, histogram: np.ndarray):
        self.count = histogram.astype(np.int64).copy()
        self.stretches = {int(n): [(int(n), 0, int(n), 0, int(histogram[n]))] for n in np.nonzero(histogram)[0]}

    def take(self, length: int, times: int) -> list[tuple[int, int, int, int, int]]:
        """So many slices of a length, as stretches."""
        self.count[length] -= times
        out, held = [], self.stretches[length]
        while times:
            n, lo, hi, rank, count = held.pop()
            used = min(count, times)
            out.append((n, lo, hi, rank, used))
            if count > used:
                held.append((n, lo, hi, rank + used, count - used))
            times -= used
        return out

    def give(self, stretches: list[tuple[int, int, int, int, int]]) -> None:
        for n, lo, hi, rank, count in stretches:
            self.count[hi - lo] += count
            self.stretches.setdefault(hi - lo, []).append((n, lo, hi, rank, count))


def _filling(count: np.ndarray, first: int, window: int) -> tuple[list[int], int]:
    """Whole pieces for one window that begins with a piece of that length, and the room they leave.

    One piece that fills the gap is best, then two that do, then the longest that fits. Each is shorter than half
    the window, so it comes from a shorter tier.
    """
    shape, room, spare = [first], window - first, count.copy()
    spare[first] -= 1
    while room:
        if spare[room]:
            n = room
        else:
            fits = np.nonzero(spare[:room])[0]
            if not len(fits):
                break
            pair = fits[spare[room - fits] > 0]
            pair = pair[(2 * pair != room) | (spare[pair] > 1)]
            n = int(pair[-1]) if len(pair) else int(fits[-1])
        shape.append(n)
        spare[n] -= 1
        room -= n
    return shape, room


#: (window, repeats, slots): windows of one size that are filled alike; a slot is (offset, stretches of slices).
Pattern = tuple[int, int, list[tuple[int, list[tuple[int, int, int, int, int]]]]]


def plan(histogram: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[Pattern]:
    """Patterns that use up the histogram, every window full.

    A gap that no whole pieces fill takes the head of a longer piece; the tail goes back to stock. The last tokens, fewer than one window, become windows of the powers of two they add up to.
    """
    stock, out = Stock(histogram), []
    for window, shorter in zip(tiers, [*tiers[1:], 0]):
        while (own := np.nonzero(stock.count[shorter + 1 : window + 1])[0]).size:
            shape, room = _filling(stock.count, int(own[-1]) + shorter + 1, window)
            lengths, times = np.unique(shape, return_counts=True)
            repeats, slots, offset, cut = int((stock.count[lengths] // times).min()), [], 0, []
            if room:
                # Of the longer pieces, those are cut that fill most windows: a rare one would be cut again and again.
                filled = np.minimum(repeats, stock.count[: window + 1])
                filled[lengths] = np.minimum(repeats, stock.count[lengths] // (times + 1))
                filled[: room + 1] = 0
                repeats, cut = int(filled.max()), [int(filled.argmax())]
                if not repeats:
                    return out + _tail(stock)
            for n in shape:
                slots.append((offset, stock.take(n, repeats)))
                offset += n
            for n in cut:
                whole = stock.take(n, repeats)
                slots.append((offset, [(o, lo, lo + room, rank, c) for o, lo, hi, rank, c in whole]))
                stock.give([(o, lo + room, hi, rank, c) for o, lo, hi, rank, c in whole])
            out.append((window, repeats, slots))
    return out


def _tail(stock: Stock) -> list[Pattern]:
    """All that is left, in a row, cut into windows of falling powers of two."""
    lengths = np.nonzero(stock.count)[0][::-1]
    rest = [(o, lo, hi, r) for n in map(int, lengths) for o, lo, hi, rank, c in stock.take(n, int(stock.count[n]))
            for r in range(rank, rank + c)]  # fewer tokens than one window, so fewer slices
    total, out = sum(hi - lo for _, lo, hi, _ in rest), []
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            slots, offset = [], 0
            while offset < 1 << bit:
                o, lo, hi, rank = rest.pop(0)
                used = min(hi - lo, (1 << bit) - offset)
                slots.append((offset, [(o, lo, lo + used, rank, 1)]))
                offset += used
                if lo + used < hi:
                    rest.insert(0, (o, lo + used, hi, rank))
            out.append((1 << bit, 1, slots))
    return out


def places(planned: list[Pattern], step_tokens: int = STEP_TOKENS) -> dict[str, np.ndarray]:
    """Where the slices of each piece go, by its length and rank.

    ``length``, ``rank``, ``at``: stretches of pieces that are cut alike; stretch i has the slices at[i] to at[i + 1],
    each with its bounds in the piece, and the window, step group and offset of the stretch's first piece.
    """
    sizes = sorted({window for window, _, _ in planned}, reverse=True)
    windows = {size: sum(r for w, r, _ in planned if w == size) for size in sizes}
    base = dict(zip(sizes, np.cumsum([0, *windows.values()]).tolist()))
    first = dict(base)
    by_length: dict[int, list[tuple]] = {}
    for window, repeats, slots in planned:
        for offset, stretches in slots:
            sequence = first[window]
            for n, lo, hi, rank, c in stretches:
                by_length.setdefault(n, []).append((rank, rank + c, lo, hi, sequence, offset, window))
                sequence += c
        first[window] += repeats
    keys, at, slices = [], [0], []
    for n in sorted(by_length):
        rows = sorted(by_length[n])
        starts = sorted({r[0] for r in rows} | {r[1] for r in rows})
        inside: list[list[tuple]] = [[] for _ in starts]
        for begin, end, lo, hi, sequence, offset, window in rows:
            for i in range(np.searchsorted(starts, begin), np.searchsorted(starts, end)):
                inside[i].append((lo, hi, sequence + starts[i] - begin, offset, window, base[window], windows[window]))
        for start, held in zip(starts[:-1], inside):
            keys.append((n, start))
            slices += sorted(held)
            at.append(len(slices))
    length, rank = np.array(keys, np.int64).reshape(-1, 2).T
    names = ("lo", "hi", "sequence", "offset", "window", "base", "windows")
    steps = max(1, -(-sum(size * n for size, n in windows.items()) // step_tokens))
    return {
        "length": length, "rank": rank, "at": np.array(at), "steps": np.int64(steps),
        **dict(zip(names, np.array(slices, np.int64).reshape(-1, len(names)).T)),
    }


def _placed(to: dict[str, np.ndarray]):
    key = to["length"] * (1 << 50) + to["rank"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            i = np.searchsorted(key, batch["length"].to_numpy() * (1 << 50) + rank, side="right") - 1
            times = to["at"][i + 1] - to["at"][i]
            row = np.repeat(np.arange(len(batch)), times)
            j = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(to["at"][i], times)
            lo, hi = to["lo"][j], to["hi"][j]
            sequence = to["sequence"][j] + (rank - to["rank"][i])[row]
            crc = []
            ids, lengths = batch["ids"].to_list(), batch["length"].to_list()
            for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist()):
                width = len(ids[r]) // lengths[r]
                crc.append(zlib.crc32(np.frombuffer(ids[r], f"<u{width}")[a:b].astype("<u4").tobytes()))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64").array[row], "start": batch["start"].to_numpy()[row] + lo, "length": hi - lo,
                    "ids_crc32": np.array(crc, np.int64), "doc_tokens": batch["doc_tokens"].to_numpy()[row], "sequence_id": sequence,
                    "offset": to["offset"][j], "window": to["window"][j].astype(np.int32),
                    "step_group": (sequence - to["base"][j]) * to["steps"] // to["windows"][j],
                }
            )

    return run


def tier_pack(
    docs: DataFrame, tiers: tuple[int, ...] = TIERS, tokenizer: str = TOKENIZER, closing: int = CLOSING,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """A row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    ``tiers`` are powers of two, longest first, each half of the one before. ``window`` is the size of the
    piece's sequence; all sequences are full. ``step_group`` numbers groups of about ``step_tokens`` tokens.

    A null or empty text is the closing id alone. Repeated rows and rows without doc_id are packed as
    documents of their own. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(rows.mapInPandas(_pieces(tiers, tokenizer, closing), PIECES), "tiers")
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(tiers[0] + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length at most
        histogram[row["length"]] = row["n"]
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "doc_tokens", "start", "length", "ids", (F.col("base") + F.col("k")).alias("rank")
    )
    return ranked.mapInPandas(_placed(places(plan(histogram, tiers), step_tokens)), PLACED)
