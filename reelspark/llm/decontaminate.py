"""Benchmark passages in documents: a prefix-filtered set join over item-sized windows, DataFrame only.

A window (ten consecutive words of an item, or a whole shorter item) is contained in a document
where all of its words stand in order. At full containment the prefix that any match must share is
one word, so each window is looked up by its rarest word, by frequency over all documents. Where that
word stands, the window's start follows from its position, the window must fit into the document, and
then the words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import written

WINDOW = 10
#: Fixed value: the words of the contract with A-Z kept; they are lowered afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above so many bytes, the lookup table of windows is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, window, n): the distinct windows of each item; words lower-cased and joined by a blank.

    Items without words have no window. Rows without item_id have windows, but are no item.
    """
    n = F.size("words")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at"), F.lit(size)).alias("words"))
        .select("item", _lowered(F.array_join("words", " ")).alias("window"), F.size("words").alias("n"))
        .distinct()
    )


def _bounded(df: DataFrame, *columns: str) -> DataFrame:
    """df as a broadcast side if its size, counted here, is within the bound."""
    width = sum((F.length(c) for c in columns), F.lit(32))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def keyed_windows(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """(window, n, token, offset): each window with its rarest word, if it occurs in the texts at all.

    The lookup word is fully lower-cased, which only ever adds places to compare.
    """
    tokens = windows.select("window", "n").distinct().select("window", "n", F.posexplode(F.split("window", " ")).alias("offset", "token"))
    tokens = written(tokens.withColumn("token", F.lower("token")), "tokens")
    vocabulary = _bounded(tokens.select("token").distinct(), "token")
    counts = (
        texts.select(F.explode_outer(words(F.col("text"))).alias("word"))
        .select(F.lower("word").alias("token"))
        .join(vocabulary, "token")
        .groupBy("token")
        .agg(F.count("*").alias("n_places"))
    )
    rarest = F.min(F.struct(F.coalesce("n_places", F.lit(0)).alias("n_places"), "token", "offset")).alias("r")
    found = tokens.join(counts, "token", "left").groupBy("window", "n").agg(rarest).where("r.n_places > 0")
    return written(found.select("window", "n", "r.token", "r.offset"), "windows")


def window_places(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc_id, start, window, n): every place where a window occurs; start counts words from 0."""
    start = F.col("pos") - F.col("offset")
    size = keyed.agg(F.coalesce(F.sum(F.length("window") + F.length("token") + 32), F.lit(0))).first()[0]
    split = texts.select("doc_id", words(F.col("text")).alias("words"))
    same = _lowered(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ")) == F.col("window")
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
    if size <= BROADCAST_BYTES:
        exploded = split.select("doc_id", "words", F.posexplode_outer("words").alias("pos", "word"))
        near = exploded.withColumn("token", F.lower("word")).join(F.broadcast(keyed), "token")
        near = near.select("doc_id", "words", F.size("words").alias("n_words"), start.alias("start"), "window", "n")
        return near.where(fits).where(same).select("doc_id", "start", "window", "n")
    exploded = split.select("doc_id", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    near = exploded.withColumn("token", F.lower("word")).join(keyed, "token")
    near = near.select("doc_id", "n_words", start.alias("start"), "window", "n").where(fits)
    return near.join(split, "doc_id").where(same).select("doc_id", "start", "window", "n").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A null text has no words. Repeated rows of a document give a row each; the places found under
    one doc_id count together. Rows without doc_id have no identity and are left out. Without items,
    or without documents, nothing is hit.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = written(item_windows(benchmark, size), "item-windows")
    places = written(window_places(texts, keyed_windows(windows, texts)), "places")
    hit = (
        places.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
        .groupBy("doc_id")
        .agg(F.count_distinct("at").alias("n_hit"))
    )
    items = (
        places.select("doc_id", "window")
        .distinct()
        .join(windows.select("item", "window"), "window")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    found = written(hit.join(items, "doc_id", "left"), "hits")
    none = F.array().cast("array<string>")
    return (
        texts.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
        .join(found, "doc_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def clean_docs(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window occurs, with their columns; rows without doc_id are kept as they are."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = written(item_windows(benchmark, size), "item-windows")
    places = written(window_places(texts, keyed_windows(windows, texts)).select("doc_id").distinct(), "hit-docs")
    return docs.join(places, "doc_id", "left_anti").select(*docs.columns)
