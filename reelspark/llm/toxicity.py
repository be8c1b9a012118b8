"""Toxicity: a lexicon learned from labels, met by Levenshtein automata in a trie, weighed by context.

Lexicon: words, and stems (beginnings of words), that stand in toxic documents far more often than in
others. A token is run through the trie of the lexicon together with a Levenshtein automaton, so
misspelled terms are found without comparing it with each of them; a token that the labels show
to be a word of its own, common in other documents, is no misspelling. A hit inside a quotation of up to
a long sentence counts less than one said straight. A logistic curve over the hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import labelled, remainder, written

#: At most about so many labelled rows are learned from.
LABELLED = 20_000
LEXICON = 3000
STEMS = (4, 5, 6)
STEM = "*"
#: G statistic a term needs, and how many times more often it has to stand in toxic documents.
EVIDENCE, RATIO = 30.0, 10.0
FUZZY_FROM = 5  # letters; shorter terms are only met exactly
#: Weight of a hit without and with an edit, and of one inside a quotation.
WEIGHTS, QUOTED_WEIGHT = (1.0, 0.6), 0.3
WORD = re.compile(r"[^\W\d_]+")
#: The context of a hit: the pair of marks around it, on one line and at most so many characters apart.
SENTENCE = 300
QUOTATION = re.compile(
    r'(?<!\w)"(?=\S)[^"\n]{1,%(n)d}(?<=\S)"(?!\w)|“[^“”\n]{1,%(n)d}”|„[^„“”\n]{1,%(n)d}[“”]|«[^«»\n]{1,%(n)d}»|»[^«»\n]{1,%(n)d}«'
    % {"n": SENTENCE}
)


def terms(text: str | None) -> set[str]:
    """Distinct lower-case words of a text, and their stems, marked."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + STEM for w in words for n in STEMS if len(w) > n}


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        toxic, other = Counter(), Counter()
        for text, y in zip(batch["text"], batch["y"]):
            (toxic if y else other).update(terms(text))
        keys = list(toxic.keys() | other.keys())
        if not keys:
            continue
        yield pd.DataFrame({"term": keys, "toxic": [toxic[k] for k in keys], "other": [other[k] for k in keys]})


def lexicon(rows: DataFrame, size: int = LEXICON) -> tuple[list[str], set[str]]:
    """The terms with the most evidence, from (text, y), and the words near them that are no misspellings.

    Stems replace longer stems and words under FUZZY_FROM letters that they begin. Other words stay beside
    them, as a misspelling in the first letters is only met through the whole word.
    """
    y = rows.groupBy("y").count().toPandas().set_index("y")["count"]
    n_toxic, n_other = int(y.get(1, 0)), int(y.get(0, 0))
    if not n_toxic or not n_other:
        return [], set()
    sums = written(
        rows.mapInPandas(_counted, "term string, toxic long, other long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")),
        "terms",
    )
    both = F.col("toxic") + F.col("other")
    share = n_toxic / (n_toxic + n_other)
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    evidence = 2 * (part(F.col("toxic"), share) + part(F.col("other"), 1 - share))
    ratio = (F.col("toxic") / n_toxic) / ((F.col("other") + 0.5) / n_other)
    best = (
        sums.withColumn("evidence", evidence)
        .where((F.col("evidence") >= EVIDENCE) & (ratio >= RATIO))
        .orderBy(F.desc("evidence"), "term")
        .limit(size)  # the lexicon's size is a parameter of the model
        .toPandas()["term"]
    )
    found: set[str] = set()
    for term in sorted(best, key=lambda t: (not t.endswith(STEM), len(t), t)):
        word = term.removesuffix(STEM)
        whole = word == term and len(word) >= FUZZY_FROM
        if whole or not any(word[:n] + STEM in found for n in STEMS if n <= len(word)):
            found.add(term)
    known = sorted(found)
    others = sums.where((F.col("other") > 0) & (ratio < RATIO) & ~F.endswith("term", F.lit(STEM))).select("term")
    own = others.mapInPandas(_fuzzy(known), "term string").toPandas()["term"]  # an edit away from a term of the lexicon
    return known, set(own)


def _fuzzy(lexicon: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield batch[[0 < matcher.weight(t) < 1 for t in batch["term"]]]

    return run


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    word: bool = False
    stem: bool = False


class Matcher:
    """Looks tokens up in the lexicon: exactly, by stem, or within an edit unless they are words of their own."""

    def __init__(self, lexicon: list[str], own: set[str] | None = None, remember: int = 200_000):
        self.words = {t for t in lexicon if not t.endswith(STEM)}
        self.stems = {t.removesuffix(STEM) for t in lexicon if t.endswith(STEM)}
        self.own = own or set()
        self.root, self.seen, self.remember = Node(), {}, remember
        self.heads: set[tuple[int, str]] = set()
        self.tails: set[tuple[int, str]] = set()
        for word in self.words:
            if len(word) < FUZZY_FROM:
                continue
            node = self.root
            for letter in word:
                node = node.next.setdefault(letter, Node())
            node.word = True
            half = len(word) // 2
            self.heads.add((len(word), word[:half]))
            self.tails.add((len(word), word[half:]))

    def near(self, token: str, edits: int = 1) -> bool:
        """Is a word of the trie within so many edits (swapped neighbours count as one)?

        The automaton's states are places in the token with the edits left. Between edits it walks down the trie
        along the token, so only the branches one edit off that path are looked at.
        """
        n, stack = len(token), [(self.root, 0, edits)]
        while stack:
            node, i, left = stack.pop()
            while node is not None:
                if node.word and n - i <= left:
                    return True
                letter = token[i] if i < n else ""
                if left:
                    if i < n:
                        stack.append((node, i + 1, left - 1))  # a letter too many
                    for following, child in node.next.items():
                        stack.append((child, i, left - 1))  # a letter lost
                        if i < n and following != letter:
                            stack.append((child, i + 1, left - 1))  # another letter
                    swapped = node.next.get(token[i + 1]) if i + 1 < n else None
                    if swapped is not None and letter in swapped.next:
                        stack.append((swapped.next[letter], i + 2, left - 1))
                node, i = node.next.get(letter), i + 1
        return False

    def _may_be_near(self, token: str) -> bool:
        """One edit leaves the first or the second half of a term whole, but for swaps across the middle."""
        n = len(token)
        for length in (n - 1, n, n + 1):
            half = length // 2
            if (length, token[:half]) in self.heads or (length, token[n - (length - half) :]) in self.tails:
                return True
            if length == n and 0 < half < n:
                swapped = token[: half - 1] + token[half] + token[half - 1] + token[half + 1 :]
                if swapped in self.words:
                    return True
        return False

    def weight(self, token: str) -> float:
        known = self.seen.get(token)
        if known is None:
            if token in self.words or any(token[:n] in self.stems for n in STEMS if n <= len(token)):
                known = WEIGHTS[0]
            elif len(token) >= FUZZY_FROM - 1 and token not in self.own and self._may_be_near(token) and self.near(token):
                known = WEIGHTS[1]
            else:
                known = 0.0
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen[token] = known
        return known

    def hits(self, text: str | None) -> float:
        """Weighed hits; those inside a QUOTATION count QUOTED_WEIGHT of their weight."""
        low, total = (text or "").lower(), 0.0
        spans, start, end = None, -1, -1
        for token in WORD.finditer(low):
            weight = self.weight(token[0])
            if weight:
                spans = spans or (m.span() for m in QUOTATION.finditer(low))
                while end < token.start():
                    start, end = next(spans, (len(low), len(low)))
                total += weight * (QUOTED_WEIGHT if start < token.start() else 1.0)
        return total


def _hits(lexicon: list[str], own: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon, own)
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "hits": [matcher.hits(t) for t in batch["text"]]})

    return run


def _features(hits: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(hits), hits > 0, np.ones(len(hits))])


def curve(hits: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, from rows that stand for n documents each."""
    weights, x = np.zeros(3), _features(hits)
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-(x @ weights)))
        slope = x.T @ (n * (y - p)) - ridge * weights
        weights = weights + np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(3), slope)
    return weights


def _scored(lexicon: list[str], own: set[str], weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon, own)
        for batch in batches:
            hits = np.array([matcher.hits(t) for t in batch["text"]], float)
            score = 1.0 / (1.0 + np.exp(-(_features(hits) @ weights)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": score})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, bound: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learned from labels.toxic outside the held-out fold, about `bound` rows at most (by hash). A null text is an
    empty one. Without toxic labels, or without others, there is no lexicon and every score is the
    share of toxic labels (zero without any). Repeated rows are scored each; a row without doc_id is scored
    and keeps its null.
    """
    learned = written(labelled(docs, labels, "toxic", modulus, held_out, bound), "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = written(rows.join(F.broadcast(learned), "doc_id").select("text", "y"), "train")  # bound rows at most
    known, own = lexicon(train)
    sums = train.mapInPandas(_hits(known, own), "y int, hits double").groupBy("hits").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    bins = sums.groupBy(F.round(F.log1p("hits") * 50).alias("bin")).agg(
        F.avg("hits").alias("hits"), F.sum("y").alias("y"), F.sum("n").alias("n")
    ).toPandas()  # a few hundred bins of a logarithm
    n = bins["n"].to_numpy(float)
    weights = curve(bins["hits"].to_numpy(float), bins["y"].to_numpy(float) / n, n) if bins["y"].sum() else np.array([0.0, 0.0, -20.0])
    scored = rows.mapInPandas(_scored(known, own, weights), "doc_id long, score double")
    fold = (remainder(modulus) == held_out).alias("held_out")
    return scored.select("doc_id", fold, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
