"""Small helpers shared by the operators: reading, scratch tables, labelled rows, learned constants."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.session import scratch_path


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on machines that hold this package at the driver's path import it, as --py-files would."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Drops the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: lineage ends here.

    The shuffle files of the write go with it, since nothing reads them again.
    """
    spark = ship(df.sparkSession)
    path, before = scratch_path(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a scratch table that no later step reads."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo n; -1 for a null doc_id, so that it is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, mark: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, y) of the rows a model may learn from: about `bound` of them at most.

    The rows come from the labels of documents outside the held-out fold; labels that
    contradict each other, and null labels, are left out. Over the bound, a share of them is
    taken by hash of doc_id, so that the sample is the same in every run.
    """
    y = F.col(mark).cast("int")
    rows = (
        labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & (remainder(modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.min(y).alias("y"), F.max(y).alias("most"))
        .where("y = most")
        .select("doc_id", "y")
    )
    rows = rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    share = min(1.0, bound / max(1, rows.count()))
    return rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1e6))
