"""Packing of tokenised documents into sequences by length patterns.

Only the histogram of piece lengths (at most 2048 numbers) is looked at as a whole. Patterns of a
few lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left is packed by filled-up patterns of
the longest remaining length, repeated as often as the histogram allows. Pieces then find their
place by the rank within their length, which is a number per task plus a running count.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import written

SEQUENCE = 2048
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


@lru_cache(maxsize=1)
def _encoders(name: str):
    """The fast encoder for ordinary text and the library that settles texts with special tokens."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """Ids of a text and the closing id 0; the same as the tokenizer's file gives without its own special tokens."""
    fast, full = _encoders(name)
    text = text or ""
    ids = full.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)
    return np.array([*ids, 0], "<u4")


def cuts(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, of which the first may be shorter."""
    first = n % sequence or min(n, sequence)
    starts = [0, *range(first, n, sequence)]
    return [(a, (first if a == 0 else sequence)) for a in starts]


def _pieces(sequence: int, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = token_ids(text, name)
                for piece, (start, length) in enumerate(cuts(len(ids), sequence)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    rows.append((doc_id, piece, start, length, crc, part, int(seen[length])))
                    seen[length] += 1
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])
            yield frame.astype({"doc_id": "Int64"})

    return run


def patterns(sequence: int = SEQUENCE, step: int = 32) -> list[tuple[int, ...]]:
    """Length patterns of one, two and three pieces that fill a sequence; of threes, those with a part on the step."""
    half = sequence // 2
    found = [(sequence,)]
    found += [(sequence - a, a) for a in range(1, half + 1)]
    for c in range(step, sequence // 3 + 1, step):
        found += [(sequence - b - c, b, c) for b in range(c, (sequence - c) // 2 + 1, 7)]
    return found


def fit(histogram: np.ndarray, shapes: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeats of each pattern, so that lengths add up to the histogram."""
    rest, repeats = histogram.astype(float), np.zeros(len(shapes))
    columns = []
    for shape in shapes:
        lengths, times = np.unique(shape, return_counts=True)
        columns.append((lengths.tolist(), times.tolist(), float((times**2).sum())))
    rest = rest.tolist()
    for _ in range(sweeps):
        moved = 0.0
        for i, (lengths, times, square) in enumerate(columns):
            gain = sum(t * rest[n] for n, t in zip(lengths, times)) / square
            change = max(gain, -repeats[i])
            if change:
                repeats[i] += change
                moved = max(moved, abs(change))
                for n, t in zip(lengths, times):
                    rest[n] -= t * change
        if moved < 0.25:
            break
    return repeats


def plan(histogram: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram: index n holds the number of pieces of length n."""
    left, out = histogram.astype(np.int64).copy(), []

    def take(shape: tuple[int, ...], most: int | None = None) -> None:
        lengths, times = np.unique(shape, return_counts=True)
        repeats = int((left[lengths] // times).min())
        repeats = repeats if most is None else min(repeats, most)
        if repeats > 0:
            left[lengths] -= repeats * times
            out.append((shape, repeats))

    present = [s for s in patterns(sequence) if all(left[n] for n in s)]
    for shape, x in zip(present, fit(left, present)):
        take(shape, int(x))
    longest = sequence
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        shape, room, spare = [longest], sequence - longest, left.copy()
        spare[longest] -= 1
        while room > 0:
            if spare[room]:
                n = room
            else:
                fits = np.nonzero(spare[:room])[0]
                if not len(fits):
                    break
                n = int(fits[-1])
                pair = fits[(fits > 0) & (spare[room - fits] > 0)]  # two that fill the room beat the longest one
                pair = pair[(2 * pair != room) | (spare[pair] > 1)]
                n = int(pair[-1]) if len(pair) else n
            shape.append(n)
            spare[n] -= 1
            room -= n
        take(tuple(shape))


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: sorted stretches (length, first rank) of sequences and offsets."""
    rows, used, base = [], {}, 0
    for shape, repeats in planned:
        offset = 0
        for n in shape:
            rows.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + repeats
            offset += n
        base += repeats
    rows.sort()
    length, rank, first, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"length": length, "rank": rank, "first": first, "offset": offset}


def _placed(at: dict[str, np.ndarray]):
    key = at["length"] * (1 << 50) + at["rank"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            i = np.searchsorted(key, batch["length"].to_numpy() * (1 << 50) + rank, side="right") - 1
            out = batch.drop(columns="rank")
            out["sequence_id"] = at["first"][i] + rank - at["rank"][i]
            out["offset"] = at["offset"][i]
            yield out

    return run


def pack(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the place of every piece of every document.

    A null or empty text is the closing id alone. Repeated rows and rows without doc_id are
    packed as documents of their own. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(rows.mapInPandas(_pieces(sequence, tokenizer), PIECES), "pieces")
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(sequence + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length at most
        histogram[row["length"]] = row["n"]
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank")
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(_placed(places(plan(histogram, sequence))), schema)
