"""Product codes of vectors, with nearest entries found in a tree of split points (GNAT) over each codebook.

Vectors become integers and are cut into equal parts; each part position has a codebook of a few entries,
improved in rounds of integer means. A codebook's tree keeps, for each split point and each subtree, the
range of distances from the point to the subtree's entries. A query that knows its distance to a split
point drops, by the triangle inequality, every subtree whose range is farther off than the best entry so
far, strictly, so that equal distances are still met and the lower index wins by integer comparison.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SPLITS = 6


def limit(dimension: int) -> int:
    """Greatest component for which the distances of whole vectors stay within 64 bits."""
    return math.isqrt((1 << 61) // max(1, dimension))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, in integers."""
    out = np.zeros((len(a), len(b)), np.int64)
    for x, y in zip(a.T, b.T):
        out += np.subtract.outer(x, y) ** 2
    return out


def _below(d2: np.ndarray) -> np.ndarray:
    """Distances, rounded so that they are never too great."""
    return np.maximum(0.0, np.sqrt(d2.astype(float)) * (1 - 1e-9) - 1e-9)


def _above(d2: np.ndarray) -> np.ndarray:
    """Distances, rounded so that they are never too small."""
    return np.sqrt(d2.astype(float)) * (1 + 1e-9) + 1e-9


@dataclass
class Node:
    """Split points with, for each pair (split point, subtree), the least and greatest distance to the subtree's entries."""

    splits: np.ndarray
    children: list[Node | None]
    low: np.ndarray
    high: np.ndarray


def tree(entries: np.ndarray, members: np.ndarray | None = None, splits: int = SPLITS) -> Node:
    """A GNAT over the entries: split points far from each other, every other entry with its nearest one."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= splits:
        return Node(members, [None] * len(members), np.empty((len(members), 0)), np.empty((len(members), 0)))
    chosen = [int(members[0])]
    nearest = squared(entries[members], entries[chosen])[:, 0]
    nearest[0] = -1
    while len(chosen) < splits:
        at = int(nearest.argmax())
        chosen.append(int(members[at]))
        nearest = np.minimum(nearest, squared(entries[members], entries[members[at : at + 1]])[:, 0])
        nearest[at] = -1
    points, rest = np.array(chosen), members[~np.isin(members, chosen)]
    to_rest = squared(entries[points], entries[rest])
    home = to_rest.argmin(0)
    low, high, children = np.full((splits, splits), np.inf), np.full((splits, splits), -np.inf), []
    for j in range(splits):
        own = home == j
        children.append(tree(entries, rest[own], splits) if own.any() else None)
        if own.any():
            low[:, j], high[:, j] = _below(to_rest[:, own].min(1)), _above(to_rest[:, own].max(1))
    return Node(points, children, low, high)


class Nearest:
    """Nearest entries of many queries at once; ``met`` counts the distances worked out."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.root, self.met = entries, tree(entries), 0

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) per query, ties to the lower index."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))
        if len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), index, best)
        return index, best

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        d2 = squared(queries[rows], self.entries[node.splits])
        self.met += d2.size
        for i, entry in enumerate(node.splits):
            closer = (d2[:, i] < best[rows]) | ((d2[:, i] == best[rows]) & (entry < index[rows]))
            index[rows[closer]], best[rows[closer]] = entry, d2[closer, i]
        inner = [j for j, child in enumerate(node.children) if child is not None]
        if not inner:
            return
        near, far = _below(d2), _above(d2)
        order = d2[:, inner].argmin(1)  # subtrees of the nearest split point first: the best entry is then soon known
        for turn in range(len(inner)):
            for place, j in enumerate(inner):
                asked = np.nonzero((order + turn) % len(inner) == place)[0]
                if not len(asked):
                    continue
                reach = _above(best[rows[asked]])
                apart = (near[asked] - node.high[:, j] > reach[:, None]) | (node.low[:, j] - far[asked] > reach[:, None])
                asked = asked[~apart.any(1)]
                if len(asked):
                    self._visit(node.children[j], queries, rows[asked], index, best)


def integers(vectors: DataFrame, dimension: int, embedding: str = "embedding") -> Column:
    """Components as floor(256 x), padded with zeros to the dimension, within its :func:`limit`."""
    most = F.lit(limit(dimension)).cast("double")
    whole = F.transform(
        F.col(embedding).cast("array<double>"),
        lambda x: F.greatest(-most, F.least(most, F.floor(F.lit(float(SCALE)) * x).cast("double"))).cast("long"),
    )
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(dimension) - F.size(whole)))


def _finite(embedding: str = "embedding") -> Column:
    value = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return value.isNotNull() & ~F.exists(value, bad)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def _sums(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, width = [Nearest(c) for c in codebooks], codebooks[0].shape[1]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        sums = [np.zeros((len(c), width), np.int64) for c in codebooks]

        def held() -> pd.DataFrame:
            rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(trees)) for e in np.nonzero(counts[p])[0]]
            return pd.DataFrame(rows, columns=["part", "entry", "n", "sums"])

        for batch in batches:
            v = _matrix(batch["v"])
            for p, find in enumerate(trees):
                own = v[:, p * width : (p + 1) * width]
                index, _ = find(own)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                np.add.at(sums[p], index, own)
            if max(int(c.max()) for c in counts) > 1 << 20:  # long before a sum leaves 64 bits
                yield held()
                for c, s in zip(counts, sums):
                    c[:], s[:] = 0, 0
        yield held()

    return run


def _codes(codebooks: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, width = [Nearest(c) for c in codebooks], codebooks[0].shape[1]
        for batch in batches:
            v = _matrix(batch["v"])
            index, error = zip(*(find(v[:, p * width : (p + 1) * width]) for p, find in enumerate(trees)))
            codes = np.stack(index, axis=1).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"],
                    "code": [row.tobytes().hex() for row in codes], "error": np.sum(error, axis=0),
                }
            )

    return run


def improved(kept: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floored mean of the parts nearest to it; unused entries stay.

    Each task adds up its own parts; what is shuffled and then read here is a row per entry.
    """
    width = codebooks[0].shape[1]
    partial = kept.select("v").mapInPandas(_sums(codebooks), "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width))
    )
    after = [c.copy() for c in codebooks]
    for row in total.collect():
        after[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return after


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def seeds(kept: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the least vec_ids, ascending; of several vectors with one vec_id the least."""
    ids = kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries)
    wanted = [row["vec_id"] for row in ids.collect()]
    known = F.col("vec_id").isin([w for w in wanted if w is not None])
    rows = kept.where(known | F.col("vec_id").isNull() if None in wanted else known)
    found = {row["vec_id"]: row["v"] for row in rows.groupBy("vec_id").agg(F.min("v").alias("v")).collect()}
    return np.array([found[w] for w in wanted], np.int64)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector has finite components only.

    Vectors shorter than the longest one, or than a multiple of ``parts``, count as padded with zeros.
    Components beyond :func:`limit` (741,455 as x at 64 dimensions) count as the limit. A null vec_id is
    greater than all others; repeated rows are coded one by one and seed one entry. Fewer vec_ids than
    entries give smaller codebooks (at most 256 entries: two hex digits), no rows an empty result.
    Extra columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(_finite())
    longest = rows.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    dimension = max(1, -(-longest // parts)) * parts
    kept = written(rows.select("vec_id", "label", integers(rows, dimension).alias("v")), "vectors")
    first = seeds(kept, entries).reshape(-1, dimension)
    schema = "vec_id long, label long, code string, error long"
    if not len(first):
        return kept.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")),
                           F.lit("").alias("codebooks_sha256"))
    codebooks = np.split(first, parts, axis=1)
    for _ in range(rounds):
        codebooks = improved(kept, codebooks)
    coded = written(kept.mapInPandas(_codes(codebooks), schema), "codes")
    discard(kept)
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = totals.withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )
