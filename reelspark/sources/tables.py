"""Manifests of files, alias and ID tables, and the tables written at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.functions.text import name_key
from reelspark.operators.ordinals import with_row
from reelspark.sources import schemas


def read_manifest(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A table of files: path, its place in the input order, and what the path points to.

    ``form``: parquet, csv (with a header), json, or text (one path per line). Lines of text are
    numbered in the order of the files' names and of the lines in them.
    """
    if form == "text":
        return _numbered_lines(spark, path).withColumn("path_type", F.lit("file"))
    reader = spark.read.schema(schemas.MANIFEST)
    if form == "csv":
        reader = reader.option("header", True)
    return reader.format(form).load(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, input_ord``: the lines of text files, numbered from 1 over all files.

    Each task reads whole stretches of files in order, so a line's number is its place in its stretch
    and the lines before that stretch: one row per stretch is counted, none of the lines is sorted. The
    lines are written once with their places, which are then the same for both.
    """
    lines = with_row(
        spark.read.text(path).select(
            F.col("value").alias("path"), F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
        ),
        "_row",
    )
    stretches = lines.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    placed = stretches.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return lines.join(placed, ["_file", "_start"]).select("path", number.cast("bigint").alias("input_ord"))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A manifest of the files under a folder. Only names are read: the content column is pruned."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return found.select(
        F.regexp_replace("path", "^file:(//)?", "").alias("path"),
        F.lit(0).cast("bigint").alias("input_ord"),
        F.lit("file").alias("path_type"),
    )


def alias_table(pairs: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """``variant, preferred`` pairs as ``variant_key, preferred``, one row per key.

    Variants that differ in case or blanks are one key; the last of them by the ``order`` columns
    holds, and the greatest spelling where nothing orders them.
    """
    keyed = pairs.select(*order, name_key(F.col("variant")).alias("variant_key"), "preferred")
    return overlay(keyed, "variant_key", "preferred", list(order))


def series_id_table(pairs: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """``series, id`` pairs as ``series_key, series_id``, one row per key, the last by ``order``.

    An unreadable ID counts as unknown (0).
    """
    keyed = pairs.select(
        *order,
        name_key(F.col("series")).alias("series_key"),
        F.coalesce(F.col("id").try_cast("int"), F.lit(0)).alias("series_id"),
    )
    return overlay(keyed, "series_key", "series_id", list(order))


def overlay(layers: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Later layers override earlier ones, key by key. Pre-aggregates before the shuffle."""
    return layers.groupBy(key).agg(
        F.max(F.struct(*order, value))[value].alias(value)
    )


def new_series_ids(known: DataFrame, learned: DataFrame) -> DataFrame:
    """IDs of newly resolved series that are not known yet."""
    return (
        learned.filter(F.col("series_id") != 0)
        .groupBy("series_key")
        .agg(F.min("series_id").alias("series_id"))
        .join(known, "series_key", "left_anti")
    )


def merge_series_ids(known: DataFrame, learned: DataFrame) -> DataFrame:
    """Known IDs plus those of newly resolved series; a known entry is never replaced."""
    return known.unionByName(new_series_ids(known, learned))


def write_version(table: DataFrame, root: str, version: int) -> str:
    """Writes one version of a table beside the older ones and returns its path.

    A version replaces only itself, so repeating a run is safe and a table that is still
    being read is never overwritten.
    """
    path = f"{root}/version={version:020d}"
    table.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return path


def write_plan(plan: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Writes a plan table, by default one folder per planning status.

    A folder per series would mean a file per series and task; the series stays a column that
    Parquet statistics serve instead. Pass ``["series"]`` for small collections.
    """
    plan.write.option("compression", "zstd").mode("overwrite").partitionBy(*(partitions or ["status"])).parquet(path)
