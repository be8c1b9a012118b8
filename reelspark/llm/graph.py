"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import discard, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v.

    Large: every larger neighbour of u moves to the least vertex near u. Small: u and its
    smaller neighbours do. The least vertex per u is a partial aggregate, and the join back has
    one row per u on one side, so that a hot vertex is split by AQE.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node that occurs in links (a, b), the least node it can reach.

    Each round is written to the shared folder; the rounds grow with the logarithm of the
    longest path. Nulls and links of a node to itself say nothing.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")
        ).first()
        if state["n"] == 0 or state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        after = written(_stars(_stars(edges, large=True), large=False), "edges")
        discard(edges)
        edges = after
