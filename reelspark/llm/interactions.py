"""Audit of filters that are applied one after another: what each removes, in every order, by a Gray-code walk.

Every document falls into one cell: the set of filters it fails. Spark counts documents per part and
cell; all that an order of the filters can say follows from those few numbers. The walk goes through
all subsets of filters so that neighbours differ by one filter. Each cell keeps a counter of the active
filters it fails; when the counter leaves or reaches zero, the cell leaves or rejoins the running
survivors. The survivors of every subset are stored, and a step of an order is the difference of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters as failure conditions over ``text`` and its ``words``.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.size("words") < 200,
    "B": lambda: 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
    "C": lambda: 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 2 * F.length("text"),
    "D": lambda: F.col("text").rlike(r"[#$%&*|]"),
}
#: The filter that a document fails whose text a smaller doc_id has.
COPIES = "E"
COUNTS = ("n", "good", "toxic")
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def survivors(cells: np.ndarray) -> np.ndarray:
    """Counts that survive each subset of filters; ``cells`` and the result are (parts, subsets, counts).

    A cell or subset is a number whose bits are its filters.
    """
    size = cells.shape[1]
    failing, running = np.zeros(size, np.int64), cells.sum(1)
    states, subset, masks = np.empty_like(cells), 0, np.arange(size)
    states[:, 0] = running
    for walked in range(1, size):
        toggled = walked & -walked  # the bit in which the Gray codes of walked - 1 and walked differ
        touched = masks & toggled != 0
        if subset & toggled:
            failing[touched] -= 1
            running = running + cells[:, touched & (failing == 0)].sum(1)
        else:
            running = running - cells[:, touched & (failing == 0)].sum(1)
            failing[touched] += 1
        subset ^= toggled
        states[:, subset] = running
    return states


def steps(states: np.ndarray, letters: str) -> dict[str, np.ndarray]:
    """The audit's numbers, each (parts, orders * filters), orders as ``permutations`` of the letters gives them."""
    k = len(letters)
    orders = np.array(list(permutations(range(k))))
    after = np.cumsum(1 << orders, axis=1)
    before, after, used = (after - (1 << orders)).ravel(), after.ravel(), orders.ravel()
    n, whole, alone = states[:, :, 0], (1 << k) - 1, 1 << np.arange(k)
    lost = states[:, before] - states[:, after]
    fails, unique = n[:, :1] - n[:, alone], n[:, whole - alone] - n[:, [whole]]
    shares = np.stack([lost[:, used == f, 0].sum(1) for f in range(k)], axis=1)
    return {
        "kept": n[:, after], "removed": lost[:, :, 0], "redundant": fails[:, used] - lost[:, :, 0],
        "unique_fails": unique[:, used], "good_lost": lost[:, :, 1], "toxic_lost": lost[:, :, 2], "shapley": shares[:, used],
    }


def _walk(letters: str):
    k = len(letters)
    names = ["".join(o) for o in permutations(letters)]
    order, step = np.repeat(names, k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):  # 64 parts at a time: bounded memory
                some = batch.iloc[at : at + 64]
                cells = np.zeros((len(some), 1 << k, len(COUNTS)), np.int64)
                for i, rows in enumerate(some["cells"]):
                    for row in rows:
                        cells[i, row["mask"]] = [row[c] for c in COUNTS]
                columns = steps(survivors(cells), letters)
                yield pd.DataFrame(
                    {
                        "part": np.repeat(some["part"].to_numpy(), len(order)), "filter_order": np.tile(order, len(some)),
                        "step": np.tile(step, len(some)), **{name: values.ravel() for name, values in columns.items()},
                    }
                )

    return run


def failures(docs: DataFrame, part: str, filters: dict[str, Callable[[], Column]]) -> DataFrame:
    """doc_id, part, mask of the filters failed, digest of the text (null without doc_id: such a row is no one's copy)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text")
    )
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(), 1 << i).otherwise(0)
    digest = F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2("text", 256)))
    return rows.select("doc_id", "part", mask.alias("mask"), digest.alias("digest"))


def cells(docs: DataFrame, labels: DataFrame, part: str, filters: dict[str, Callable[[], Column]]) -> DataFrame:
    """part, mask, n, good, toxic: documents per part and set of failed filters; the last bit is that of copies.

    Rows become counts before every shuffle. Of each text only its count per part and mark, and the count
    of its least doc_id, travel on: a text that a third of all rows share is at most four rows per part.
    """
    rows = failures(docs, part, filters).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("m"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    rows = rows.join(marked, "doc_id", "left").fillna(0, ["good", "toxic"])
    texts = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("m").alias("n"), F.min(F.struct("doc_id", "m")).alias("first")
    )
    least = texts.where("digest is not null").groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    texts = texts.join(least, "digest", "left")
    originals = F.when(F.col("least").isNull(), F.col("n")).when(F.col("first.doc_id") == F.col("least"), F.col("first.m")).otherwise(0)
    split = texts.select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask").alias("mask"), originals.alias("n")),
                F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - originals).alias("n")),
            )
        ).alias("cell"),
    )
    return split.groupBy("part", "cell.mask").agg(
        F.sum("cell.n").alias("n"),
        F.sum(F.col("cell.n") * F.col("good")).alias("good"),
        F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict[str, Callable[[], Column]] | None = None
) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` maps a letter to a failure condition over ``text`` and ``words``; the copies filter E comes last.

    A null text is an empty one, a null part the empty string. A repeated row counts as a document of its own
    and is no earlier one than its twin; a row without doc_id counts, has no labels and is in no group of
    copies. Of several labels for a document any 1 counts. No documents give no rows. Extra columns are ignored.
    """
    filters = FILTERS if filters is None else filters
    counted = cells(docs, labels, part, filters)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # one entry per subset at most
    return parts.mapInPandas(_walk("".join(filters) + COPIES), AUDIT)
