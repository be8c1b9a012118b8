"""Removal of repeated byte strings by sparse prefix doubling.

A suffix array over every byte needs a row for each byte and round. The rounds here keep only the
positions that can still matter, and stay exact:

* Rank at 32 bytes, at sampled positions only. Each window of 100 bytes is represented by the least
  32-byte hash in it (its anchor). Equal windows have equal anchors at equal offsets, so windows
  without an anchor in common cannot be equal. An anchor whose hash occurs once is unique: done.
* Rank at the anchor's reach, the bytes of all windows it represents (up to 168). Of anchors with
  equal reach all but the first are repeats as a whole: past the threshold, done.
* Rank at 100 bytes, for the windows of anchors that share 32 bytes but not their whole reach.

In each round Spark deals out (rank, position) rows by rank and sorts them; a streaming pass sees
which ranks occur again, holding a row or two at a time whatever the size of a group. Equal reaches in
one batch of texts are settled before the shuffle, so a text that repeats itself is cheap.
Ranks are 128 bits (two independent 64-bit hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import written

SPAN = 100
GRAM = 32
CHUNK = 1 << 20
_U = np.uint64
RANKED = "gram long, rank long, doc_id long, lo long, shape long"


@lru_cache(maxsize=1)
def _tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For two hashes: random words per byte, powers of an odd base and of its inverse, as long as a chunk."""
    random, n = np.random.Generator(np.random.PCG64(20)), CHUNK + SPAN

    def powers(b: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) <= n:
            out = np.concatenate((out, out * _U(pow(b, len(out), 1 << 64))))
        return out[: n + 1]

    tables = []
    for _ in range(2):
        base = int(random.integers(0, 1 << 63)) * 2 + 1
        tables.append((random.integers(0, 1 << 64, 256, np.uint64), powers(base), powers(pow(base, -1, 1 << 64))))
    return tables


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _longer(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """Doubling: hashes of strings a at i followed by b at i + by."""
    n = len(b) - by
    return _mix(a[:n] * _U(0x9E3779B97F4A7C15) + b[by:])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position, by doubling from one byte."""
    hashes, length = _tables()[0][0][data], 1
    while length < GRAM:
        hashes = _longer(hashes, hashes, length)
        length *= 2
    return hashes


def stretch_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hash of the bytes [start, end), the same wherever they stand."""
    word, power, inverse = _tables()[which]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(word[data] * power[: len(data)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * inverse[start])


def anchors(data: np.ndarray, window_ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash of the anchor's gram) of each run of windows with one anchor.

    window_ok: whether a window may start at a position (of len(data) - 99).
    """
    gram = gram_hashes(data)
    least = (gram & _U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, wide = SPAN - GRAM + 1, 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if width > wide:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    at = np.nonzero(window_ok)[0]
    if not len(at):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    anchor = (least[at] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    lo = at[new]
    hi = at[np.concatenate((np.nonzero(new)[0][1:] - 1, [len(at) - 1]))]
    return anchor[new], lo, hi, gram[anchor[new]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, doc_id, start in chunk, start in text) of texts or parts of texts of about CHUNK bytes together.

    The parts of a long text overlap by 99 bytes, so that each window is in one of them.
    """
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush():
        starts = np.cumsum([0, *(len(x[2]) for x in held)])
        return (
            np.concatenate([x[2] for x in held]), np.array([x[0] for x in held], np.int64),
            starts[:-1], np.array([x[1] for x in held], np.int64),
        )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            data = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
            for at in range(0, max(1, len(data) - SPAN + 1), CHUNK // 2):
                part = data[at : at + CHUNK // 2 + SPAN - 1]
                if len(part) < SPAN:
                    continue
                if held and size + len(part) > CHUNK:
                    yield flush()
                    held, size = [], 0
                held.append((doc_id, at, part))
                size += len(part)
    if held:
        yield flush()


def _frame(gram, rank, doc_id, lo, shape) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(x).view(np.int64)) for x in (gram, rank, doc_id, lo, shape)],
        names=["gram", "rank", "doc_id", "lo", "shape"],
    )


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with their reach: lo is the first window, shape the number of further windows.

    Repeats that a chunk shows by itself are whole stretches: shape is minus their length in bytes, gram a
    hash of the document that spreads them.
    """
    for data, docs, starts, offsets in _chunks(batches):
        place = np.repeat(np.arange(len(docs)), np.diff(np.append(starts, len(data))))
        ok = place[: len(data) - SPAN + 1] == place[SPAN - 1 :]
        anchor, lo, hi, gram = anchors(data, ok)
        if not len(anchor):
            continue
        rank = _mix(stretch_hashes(data, lo, hi + SPAN) + (anchor - lo).astype(np.uint64) * _U(0x94D049BB133111EB))
        doc = docs[place[lo]]
        where = lo - starts[place[lo]] + offsets[place[lo]]
        order = np.lexsort((where, doc, rank, gram))
        gram, rank, doc, where, more = gram[order], rank[order], doc[order], where[order], (hi - lo)[order]
        same = (gram[1:] == gram[:-1]) & (rank[1:] == rank[:-1])
        first = np.concatenate(([True], ~same))
        head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        again = (doc != doc[head]) | (where != where[head])
        yield _frame(gram[~again], rank[~again], doc[~again], where[~again], more[~again])
        if again.any():
            doc, start, end = merge(doc[again], where[again], where[again] + more[again] + SPAN)
            yield _frame(_mix(doc.view(np.uint64)), _mix(start.view(np.uint64)), doc, start, start - end)


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each document, joined where they touch."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    number = np.cumsum(new_doc)
    shift = number * (int(end.max()) + 2)  # documents one behind the other, never touching
    far = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], (start + shift)[1:] > far[:-1]))
    last = np.concatenate((np.nonzero(new)[0][1:] - 1, [len(doc) - 1]))
    return doc[new], start[new], (far - shift)[last]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, rank, doc_id, lo) to kind, doc_id, lo, shape.

    kind 0: a repeated stretch of shape bytes from lo. kind 1: an anchor that shares its gram with another reach;
    its shape + 1 windows have to be ranked. State: the last row, the first row of its rank, and the first
    reach of its gram while no other has come.
    """
    last = head = pending = None
    for batch in batches:
        gram, rank, doc, lo, shape = (batch.column(n).to_numpy() for n in ("gram", "rank", "doc_id", "lo", "shape"))
        if not len(gram):
            continue
        whole = shape < 0
        before = last if last is not None else (int(gram[0]) ^ 1, 0)
        new_gram = gram != np.concatenate(([before[0]], gram[:-1]))
        new_rank = new_gram | (rank != np.concatenate(([before[1]], rank[:-1])))
        at = np.maximum.accumulate(np.where(new_rank, np.arange(len(gram)), -1))
        head_doc = np.where(at >= 0, doc[at], head[0] if head else 0)
        head_lo = np.where(at >= 0, lo[at], head[1] if head else 0)
        again = ~new_rank & ((doc != head_doc) | (lo != head_lo)) & ~whole
        kinds, out = [], []
        rows = np.nonzero(again | whole)[0]
        out.append((doc[rows], lo[rows], np.where(whole[rows], -shape[rows], shape[rows] + SPAN)))
        kinds.append(np.zeros(len(rows), np.int64))
        heads = np.nonzero(new_rank & ~whole)[0]
        if len(heads):
            opens = new_gram[heads]
            if pending is not None and not opens[0]:
                out.append(tuple(np.array([x], np.int64) for x in pending))
                kinds.append(np.ones(1, np.int64))
            follows = np.concatenate((~opens[1:], [False]))
            rows = heads[~opens | follows]
            out.append((doc[rows], lo[rows], shape[rows]))
            kinds.append(np.ones(len(rows), np.int64))
            i = heads[-1]
            pending = (int(doc[i]), int(lo[i]), int(shape[i])) if opens[-1] else None
        last = (int(gram[-1]), int(rank[-1]))
        head = (int(head_doc[-1]), int(head_lo[-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(kinds).astype(np.int32))] + [pa.array(np.concatenate(x)) for x in zip(*out)],
            names=["kind", "doc_id", "lo", "shape"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marks) to a ranked row per window of the marked anchors; marks hold first window and count."""
    for batch in batches:
        for doc_id, text, marks in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("marks").to_pylist()):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            lo = np.array([m["lo"] for m in marks], np.int64)
            count = np.array([m["shape"] for m in marks], np.int64) + 1
            inside = (lo >= 0) & (lo + count + SPAN - 1 <= len(data))
            lo, count = lo[inside], count[inside]
            order = np.argsort(lo)
            lo, count = lo[order], count[order]
            for at in range(0, max(1, len(data) - SPAN + 1), CHUNK // 2):
                here = (lo < at + CHUNK // 2) & (lo + count > at)
                if not here.any():
                    continue
                part = data[at : at + CHUNK // 2 + SPAN - 1]
                rows = np.repeat(lo[here], count[here]) + _runs(count[here])
                rows = np.unique(rows[(rows >= at) & (rows < at + CHUNK // 2)]) - at
                gram, rank = (stretch_hashes(part, rows, rows + SPAN, which) for which in (0, 1))
                yield _frame(gram, rank, np.full(len(rows), doc_id, np.int64), rows + at, np.zeros(len(rows), np.int64))


def _runs(count: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, marks in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("marks").to_pylist()):
            data = memoryview(text.as_buffer() if text.is_valid else b"")
            lo = np.array([m["lo"] for m in marks or ()], np.int64)
            end = np.minimum(lo + np.array([m["shape"] for m in marks or ()], np.int64), len(data))
            _, lo, end = merge(np.zeros(len(lo), np.int64), lo, end)
            rest, at = hashlib.sha256(), 0
            for a, b in zip(lo.tolist(), end.tolist()):
                rest.update(data[at:a])
                at = b
            rest.update(data[at:])
            rows.append((doc_id, len(data), int((end - lo).sum()), len(lo), rest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int64()] * 4 + [pa.string()])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _settle(ranked: DataFrame) -> DataFrame:
    at = ["gram", "rank", "doc_id", "lo"]
    sorted_rows = ranked.repartition("gram").sortWithinPartitions(*at)
    return sorted_rows.mapInArrow(_settled, "kind int, doc_id long, lo long, shape long")


def _with_marks(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Texts with the marks of their document as one array; a document has no more marks than bytes."""
    gathered = marks.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "shape")).alias("marks"))
    return texts.join(gathered, "doc_id", how)


def repeated_stretches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, marks): the documents with an id, and the stretches (doc_id, lo, shape bytes) of them to remove."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(_settle(texts.mapInArrow(_reaches, RANKED)), "reaches")
    open_anchors = first.where("kind = 1")
    windows = _with_marks(texts.where("text is not null"), open_anchors, "inner").mapInArrow(_windows, RANKED)
    second = written(_settle(windows).where("kind = 0"), "windows")
    marks = first.where("kind = 0").unionByName(second).select("doc_id", "lo", "shape")
    return texts, marks


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Each byte covered by a 100-byte string that also starts earlier (smaller doc_id, or the same
    document, earlier start) goes. A null text is empty. Rows of one doc_id are one document to each
    other: a repeated row neither removes its twin nor itself. Rows without doc_id are left out.
    """
    texts, marks = repeated_stretches(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_marks(texts, marks, "left").mapInArrow(_kept, schema)
