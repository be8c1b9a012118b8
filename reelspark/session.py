"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on; all of them are ordinary SQL options.

    Joins here never carry a broadcast hint for data that can grow. Every join is planned as a shuffle,
    and AQE turns those into broadcasts whose smaller side has been measured, once shuffled, as small:
    sizes estimated beforehand are those of compressed files and know nothing of what an ``explode``
    adds, so tables of many times the driver's memory passed for small ones. Beyond that size AQE splits
    skewed keys, also where the split costs one more shuffle later on. Small partitions are left apart
    where there are cores for them: a join may make many pairs of few rows.

    The shuffle files of a finished job go at once. The plans run several jobs, each of which writes its rows, and
    files that stay until the driver collects its garbage would fill the disks with the shuffles of all of them.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "4k")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables: the one the cluster names.

    Only a local session without ``spark.checkpoint.dir`` (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="reelspark-")
        context.setCheckpointDir(folder)
    return folder


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's scratch tables under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path of its own among this application's scratch tables."""
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept(table: DataFrame, label: str) -> DataFrame:
    """The table, run now and kept as Parquet in the shared folder."""
    spark, path = table.sparkSession, scratch_path(table.sparkSession, label)
    table.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes a scratch table, as ``kept`` returned it, that no later step reads."""
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        remove(table.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of scratch data, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this session. Plans made from them cannot be read any more."""
    remove(spark, session_dir(spark))
