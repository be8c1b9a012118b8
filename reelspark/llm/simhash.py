"""Near-duplicates by SimHash: segment popcounts, a grid under Manhattan distance, exact check.

A fingerprint of 64 bits is 32 segments of two bits. Its embedding is the popcount of each
segment; the Manhattan distance of two embeddings is never more than the Hamming distance of the
fingerprints. The 32 coordinates form seven zones. Within distance 4, at most four zones can
differ, so two linked fingerprints share the grid cell of at least three whole zones: the join is
an equality on one of the 35 zone triples. Inside a cell the Manhattan bound goes first and the
exact distance decides.

Cells larger than CELL are split by hash, and each pair of parts meets in its own cell. What leaves
a cell is not its pairs but a star per connected group, so rows out never exceed rows in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import written
from reelspark.llm.fingerprints import fingerprint_batches
from reelspark.llm.graph import components

DISTANCE = 4
ZONES = 7
CELL = 1024
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def zone_masks(distance: int = DISTANCE, zones: int = ZONES) -> list[int]:
    """For each choice of zones that must agree, the bits of their segments."""
    parts = np.array_split(np.arange(32), zones)
    bits = [sum(3 << (2 * int(s)) for s in part) for part in parts]
    return [sum(bits[z] for z in chosen) for chosen in combinations(range(zones), zones - distance)]


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: 32 two-bit fields, each the popcount of its segment."""
    low = np.uint64(_LOW)
    return ((fp >> np.uint64(1)) & low) + (fp & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of embeddings with coordinates 0, 1, 2: a field of a ^ b is 1, 3 for 1 and 2 for 2."""
    low, x = np.uint64(_LOW), a ^ b
    return np.bitwise_count(x & low) + 2 * np.bitwise_count((x >> np.uint64(1)) & low & ~x)


def cell_stars(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by cell: (fingerprint, least fingerprint of its connected group in these rows)."""
    embedded, at, step = popcounts(fp), np.arange(len(fp)), 1
    left, right = [], []
    while True:
        at = at[at + step < len(fp)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        near = at[manhattan(embedded[at], embedded[at + step]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        left.append(near)
        right.append(near + step)
        step += 1
    if not left:
        return fp[:0], fp[:0]
    nodes, index = np.unique(fp, return_inverse=True)
    a, b = index[np.concatenate(left)], index[np.concatenate(right)]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        root = root[root]
        if (root == before).all():
            break
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def _stars(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[["part", "key", "i", "j"]].to_numpy()
            change = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0]
            cut = int(change[-1]) + 1 if len(change) else 0
            rest = rows.iloc[cut:]
            yield from emit(rows.iloc[:cut], keys[:cut])
        if rest is not None:
            yield from emit(rest, rest[["part", "key", "i", "j"]].to_numpy())

    def emit(rows: pd.DataFrame, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(rows) < 2:
            return
        cell = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
        a, b = cell_stars(cell, rows["fp"].to_numpy().view(np.uint64), distance)
        if len(a):
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def near_links(prints: DataFrame, distance: int = DISTANCE, zones: int = ZONES, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within the distance do.

    prints: distinct fingerprints, column fp.
    """
    high, low = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_LOW)), F.col("fp").bitwiseAND(F.lit(_LOW))
    embedded = high.bitwiseXOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))  # their sum, field by field
    cells = F.array(
        *(
            F.struct(F.lit(n).alias("part"), F.col("embedded").bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for n, mask in enumerate(zone_masks(distance, zones))
        )
    )
    keyed = (
        prints.select("fp", embedded.alias("embedded")).select("fp", F.explode(cells).alias("c")).select("fp", "c.part", "c.key")
    )
    large = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    lanes = F.coalesce(F.ceil(F.col("n") / F.lit(cell)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("lanes")).cast("int")
    other = F.when(F.col("lanes") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("lanes") - 1), F.col("own"))
    )
    placed = (
        keyed.join(large, ["part", "key"], "left")
        .withColumn("lanes", lanes)
        .withColumn("own", own)
        .select("part", "key", "fp", "own", F.explode(other).alias("other"))
        .select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    at = ["part", "key", "i", "j"]
    return placed.repartition(*at).sortWithinPartitions(*at).mapInPandas(_stars(distance), "a long, b long")


def simhash_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over links.

    docs: doc_id, text. A null or empty text, or one without words, has fingerprint zero and is
    linked like any other. Repeated rows of a document give one row each. Rows without doc_id
    have no identity and are left out. An empty table gives an empty result.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(texts.mapInPandas(fingerprint_batches, "doc_id long, fp long"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(near_links(distinct.select("fp"), distance))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    group = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(group, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the least of its group, one row per document."""
    groups = simhash_groups(docs)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
