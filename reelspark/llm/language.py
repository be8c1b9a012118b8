"""Language by rank order: a text's most frequent n-grams against the profile of each language.

Profiles come from the n-gram counts of all documents that may be learned from: counted per Arrow
batch, summed by Spark, cut to the PROFILE most frequent. A text's distance to a language is the sum
of how far each of its n-grams is out of place, with the greatest distance for those the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.common import remainder

PROFILE = 400
TOP = 300
EDGE = 1  # stands for the edge of a word
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or EDGE."""
    table = np.full(0x110000, EDGE, np.uint64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) for lengths 1 to 3 over the letters of a text; no letter, no n-gram.

    An n-gram is its code points, 21 bits each. The edge of a word counts as a letter in lengths 2 and 3.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    letter = np.concatenate(([EDGE], letter, [EDGE])).astype(np.uint64)
    letter = letter[np.concatenate(([True], (letter[1:] != EDGE) | (letter[:-1] != EDGE)))]
    ones = letter[letter != EDGE]
    if not len(ones):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    shift = np.uint64(21)
    pairs = (letter[:-1] << shift) | letter[1:]
    triples = (pairs[:-1] << shift) | letter[2:]
    return np.unique(np.concatenate((ones, pairs, triples)), return_counts=True)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            whole = [grams(t) for t in texts]
            keys, place = np.unique(np.concatenate([k for k, _ in whole]), return_inverse=True)
            if not len(keys):
                continue
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, np.concatenate([c for _, c in whole]))
            yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": sums})


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to n-grams, most frequent first (ties: the smaller n-gram), from all rows with text and lang."""
    rows = docs.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    sums = rows.mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= size).toPandas()  # languages x profile size
    return {
        lang: rows.sort_values("rank")["gram"].to_numpy().view(np.uint64) for lang, rows in sorted(top.groupby("lang"))
    }


def distances(text: str | None, known: tuple[np.ndarray, np.ndarray], top: int, size: int) -> np.ndarray | None:
    """Mean out-of-place distance to each language, 0 to 1; None for a text without letters."""
    keys, counts = grams(text)
    if not len(keys):
        return None
    own = np.lexsort((keys, -counts))[:top]
    vocabulary, ranks = known
    place = np.searchsorted(vocabulary, keys[own])
    place[place == len(vocabulary)] = 0
    at = np.where((vocabulary[place] == keys[own])[:, None], ranks[place], -1)
    out = np.where(at < 0, size, np.abs(at - np.arange(len(own))[:, None]))
    return np.minimum(out, size).mean(axis=0) / size


def _predicted(langs: list[str], known: tuple[np.ndarray, np.ndarray], top: int, size: int):
    def one(text: str | None) -> tuple[str, float]:
        far = distances(text, known, top, size) if langs else None
        if far is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(far))
        rest = np.delete(far, best)
        return langs[best], float(1.0 - far[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(t) for t in batch["text"]], columns=["lang_pred", "score"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out.insert(1, "held_out", batch["held_out"].to_numpy())
            yield out

    return run


def language(docs: DataFrame, modulus: int = 4, held_out: int = 2, size: int = PROFILE, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, learned from rows outside the held-out fold.

    score: how much nearer the best language is than the next (1: the others are as far as can be;
    also with one language known). Without a text, a letter or a language to learn from: `und`, 0.
    Ties go to the language first in the alphabet. Repeated rows count and are predicted each; a row
    without doc_id is in no fold, is predicted, and keeps its null.
    """
    fold = remainder(modulus)
    learned = profiles(docs.where((fold != held_out) & F.col("doc_id").isNotNull()), size)
    langs = list(learned)
    vocabulary = np.unique(np.concatenate([*learned.values(), np.empty(0, np.uint64)]))
    ranks = np.full((len(vocabulary), len(langs)), -1)
    for i, lang in enumerate(langs):
        ranks[np.searchsorted(vocabulary, learned[lang]), i] = np.arange(len(learned[lang]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == held_out).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.mapInPandas(_predicted(langs, (vocabulary, ranks), top, size), schema)
