"""Numbering rows without ever putting one big group into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.session import discard
from reelspark.session import kept as _kept

# Column that numbers the rows whose claims are settled; see first_claims.
ROW = "_claim_row"

# Row numbers that share one bitmap (as many as bitmap_construct_agg takes), and how many bitmaps, of 4 KB each, are broadcast at most.
IN_BITMAP = 1 << 15
BITMAPS = 1 << 14


def number_rows(
    rows: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "ordinal"
) -> DataFrame:
    """Adds the 1-based position (BIGINT) of each row in its group, or overall.

    ``order`` must end in a key that is unique in the group. Whatever the size of a group, rows
    are sorted across the cluster by group and order; a row's number is its place in that sort
    less the place where its group begins, which is a partial aggregate.
    """
    placed = _positions(rows, [*map(F.col, within), *order])
    if not within:
        return placed.withColumnRenamed("_position", name)
    starts = placed.groupBy(*(F.col(c).alias(f"_{c}") for c in within)).agg(F.min("_position").alias("_start"))
    same = None
    for c in within:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = test if same is None else same & test
    return (
        placed.join(starts, same, "inner")
        .withColumn(name, F.col("_position") - F.col("_start") + 1)
        .drop("_position", "_start", *(f"_{c}" for c in within))
    )


def _positions(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``_position``: the 1-based place in the order over all rows.

    The rows are written first, so that sampling for the sort does not work them out again.
    A range-partitioned sort gives each task a stretch of the order; it is written too, so a lost
    executor cannot shift rows between stretches. The lengths of the stretches (one small row per
    partition) turn into offsets.
    """
    spark = rows.sparkSession
    in_task = 33  # monotonically_increasing_id: partition number above, row number below
    given = _kept(rows, "given")
    ordered = _kept(given.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    discard(given)
    lengths = (
        ordered.groupBy(F.shiftright("_row", in_task).alias("_stretch"))
        .agg(F.count("*").alias("_length"))
        .orderBy("_stretch")
        .collect()
    )
    offsets, total = [], 0
    for stretch in lengths:
        offsets.append((stretch["_stretch"], total))
        total += stretch["_length"]
    table = spark.createDataFrame(offsets, "_stretch bigint, _offset bigint")
    local = F.col("_row").bitwiseAND(F.lit((1 << in_task) - 1).cast("bigint"))
    return (
        ordered.withColumn("_stretch", F.shiftright("_row", in_task))
        # One row per partition of the sort: bounded by the number of tasks, not by data.
        .join(F.broadcast(table), "_stretch")
        .withColumn("_position", F.col("_offset") + local + 1)
        .drop("_row", "_stretch", "_offset")
    )


def with_row(rows: DataFrame, name: str = ROW) -> DataFrame:
    """The rows, written to the shared folder once, with a number of their own (BIGINT, not dense)."""
    return _kept(rows.withColumn(name, F.monotonically_increasing_id()), "rows")


def first_claims(
    rows: DataFrame,
    target: str,
    order: Sequence[Column],
    name: str,
    taken: DataFrame | None = None,
    grant: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Adds a flag: is this row the first, in the given order, to claim its target?

    ``rows`` comes from ``with_row``, or is cheap to read twice and has its number: of rows equal
    in ``order`` the lower number wins. Null targets claim nothing and get null. ``taken`` holds
    targets (its first column) that are gone before any row asks. ``grant`` gets a row per target (column
    ``path``) that some row may have, and returns those that nobody got in an earlier run.

    The winner of a target is a minimum, combined before the shuffle, so a target that half of
    all rows claim is one row per task. Only targets are shuffled, and of ``taken`` only what this
    run wants gets any further. The winners' numbers are kept as bitmaps, which find the rows where they are; see
    :func:`_marked`.
    """
    wanted = F.col(target)
    winners = (
        rows.filter(wanted.isNotNull())
        .groupBy(wanted.alias("_target"))
        .agg(F.min(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), F.col(ROW)))[ROW].alias(ROW))
    )
    if taken is not None:
        gone = taken.select(F.col(taken.columns[0]).alias("_target"))
        winners = winners.join(gone, "_target", "left_anti")
    if grant is not None:
        asked = _kept(winners, "asked")
        winners = asked.join(grant(asked.select(F.col("_target").alias("path"))).toDF("_target"), "_target", "left_semi")
    return _marked(rows, _kept(winners.select(ROW), "winners"), F.col(target).isNotNull(), name)


def _marked(rows: DataFrame, winners: DataFrame, claims: Column, name: str) -> DataFrame:
    """Adds a flag to rows that claim something: is their number among ``winners`` (a kept table)? Null to the others.

    A bit per row is so little that the bitmaps go to the rows: up to ``BITMAPS`` of them (64 MB, half a billion
    rows), counted, are broadcast and the rows do not move. Beyond that, rows and winners are joined by number,
    a key that cannot be skewed.
    """
    bits = _kept(
        winners.repartition((F.shiftright(ROW, 15)).alias("_bitmap")).groupBy(F.shiftright(ROW, 15).alias("_bitmap"))
        .agg(F.bitmap_construct_agg(F.pmod(ROW, F.lit(IN_BITMAP))).alias("_bits")),
        "bitmaps",
    )
    if bits.count() > BITMAPS:
        discard(bits)
        won = rows.join(winners.withColumn("_won", F.lit(True)), ROW, "left")
    else:
        discard(winners)
        place = F.pmod(ROW, F.lit(IN_BITMAP)).cast("int")
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        found = rows.join(F.broadcast(bits), F.shiftright(ROW, 15) == F.col("_bitmap"), "left")
        won = found.withColumn("_won", F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1)
    return won.withColumn(name, F.when(claims, F.coalesce("_won", F.lit(False)))).select(*rows.columns, name)
