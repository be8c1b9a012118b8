"""Files that keep arriving: the batch operators over micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelspark.operators.infer import TV, MediaSpec
from reelspark.plans.pipeline import Options, Reference, named, process, resolution
from reelspark.session import kept
from reelspark.sources import schemas
from reelspark.sources.tables import new_series_ids, write_version


def manifest_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Manifest tables as they land in a folder."""
    reader = spark.readStream.schema(schemas.MANIFEST)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def dedup_arrivals(files: DataFrame, time: str, delay: str) -> DataFrame:
    """Each path once, however often it is announced within ``delay``; state expires after it."""
    return files.withWatermark(time, delay).dropDuplicatesWithinWatermark(["path"])


def split_late(files: DataFrame, time: str, delay: str, root: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream to a table of versions at ``root`` and marks in ``late`` what came too late.

    Late is a row whose ``time`` is null or not after the watermark, the greatest time of all batches before
    less ``delay``. A stateful operator would drop such rows unseen; here every row is kept, on one side or the other:
    ``timely`` gives the stream of those in time, ``late_rows`` the table of the others. Each batch writes
    the greatest time so far beside its rows and reads that of the batch before only, so its
    cost does not grow with the stream; a repeated batch writes the same again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, reached = batch.sparkSession, None
        if batch_id > 0:
            reached = spark.read.parquet(f"{root}-reached/version={batch_id - 1:020d}").first()["reached"]
        when, limit = F.col(time), F.timestamp_micros(F.lit(reached).cast("long")) - F.expr(f"interval {delay}")
        rows = batch.withColumn("late", when.isNull() | F.coalesce(when <= limit, F.lit(False)))
        written = f"{root}/version={batch_id:020d}"
        rows.write.option("compression", "zstd").mode("overwrite").partitionBy("late").parquet(written)
        times = spark.read.schema(batch.schema).parquet(written)
        top = F.greatest(F.max(F.unix_micros(when)), F.lit(reached).cast("long"))
        write_version(times.agg(top.alias("reached")), f"{root}-reached", batch_id)

    return _start(files, step, checkpoint)


def timely(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The stream of the rows that ``split_late`` found in time."""
    rows = spark.readStream.schema(f"{schema}, version bigint, late boolean").parquet(root)
    return rows.filter(~F.col("late")).drop("version", "late")


def late_rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows that ``split_late`` found too late, with the batch (``version``) they came in."""
    return spark.read.schema(f"{schema}, version bigint, late boolean").parquet(root).filter("late").drop("late")


def _start(
    files: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        files.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_plan(
    files: DataFrame,
    reference: Reference,
    sink: str,
    checkpoint: str,
    options: Options | None = None,
    listing: DataFrame | None = None,
    spec: MediaSpec = TV,
    claims: str | None = None,
) -> StreamingQuery:
    """Plans each micro-batch with the batch plan and writes it as its own version.

    A batch that is run again after a failure replaces its own folder, so every file is
    planned exactly once. Targets that earlier batches gave away count as taken, like those in
    ``listing``: they are keyed state, one ``KeyedClaims`` for renaming and one for organising, in
    folders under ``claims`` (the sink's name with ``-claims`` unless given). Both kinds are apart, as
    in ``process``, so batches in the order of the input give the plan of one run over all files.
    """
    root = claims or f"{sink.rstrip('/')}-claims"
    # Every batch reads these tables, none of which changes: they are worked out once.
    reference = reference.kept()
    listing = listing if listing is None else kept(listing.select("path"), "listing")
    kinds = {kind: KeyedClaims(f"{root}/{kind}") for kind in ("rename", "organize")}

    def step(batch: DataFrame, batch_id: int) -> None:
        grants = {kind: lambda asked, k=k: k.grant(asked, batch_id) for kind, k in kinds.items()}
        write_version(process(batch, reference, options, listing, spec, grants), sink, batch_id)

    return _start(files, step, checkpoint)


@dataclass(frozen=True)
class KeyedClaims:
    """Paths that the batches of a stream have given away, as keyed state of a stream of their own.

    The state is a RocksDB store hashed by path: a batch looks up the paths it asks for and reads nothing that
    earlier ones wrote, so its cost follows its own rows. Under ``root`` lie ``asked`` and ``granted``, a version
    per batch, and ``state``, the checkpoint of the stream from one to the other.
    """

    root: str

    def grant(self, asked: DataFrame, version: int) -> DataFrame:
        """The paths among ``asked`` (one column, ``path``) that no earlier version was granted.

        A null path is never granted. A version's questions are written once. One that is run again after a
        failure gets the answer of its first run, whether the state had taken it in or not; a path that
        it did not ask for then is not granted now.
        """
        spark, answer = asked.sparkSession, f"{self.root}/granted/version={version:020d}"
        if not _complete(spark, f"{self.root}/asked/version={version:020d}"):
            write_version(asked.filter("path is not null").distinct(), f"{self.root}/asked", version)
        if not _complete(spark, answer):
            spark.conf.set(
                "spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            )
            questions = spark.readStream.schema("path string, version bigint").parquet(f"{self.root}/asked")
            first = questions.dropDuplicates(["path"]).select("path")
            _start(first, lambda new, _: new.write.mode("overwrite").parquet(answer), f"{self.root}/state").awaitTermination()
        return spark.read.schema("path string").parquet(answer)


def _complete(spark: SparkSession, folder: str) -> bool:
    """Has a job that writes this folder been committed?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def earlier_versions(spark: SparkSession, root: str, before: int, schema: str) -> DataFrame:
    """The rows of all versions of a table before one; whole versions are pruned."""
    versions = spark.read.schema(f"{schema}, version bigint").parquet(root)
    return versions.filter(F.col("version") < before).drop("version")


def stream_learn_ids(
    files: DataFrame,
    reference: Reference,
    sink: str,
    checkpoint: str,
    spec: MediaSpec = TV,
) -> StreamingQuery:
    """Remembers the first resolution of each series: per batch, a version with its new IDs only.

    Batch n knows the given table and the versions before n, so a repeated batch writes the same
    again. ``known_ids`` gives the whole table.
    """

    reference = reference.kept(episodes=False)

    def step(batch: DataFrame, batch_id: int) -> None:
        known = known_ids(batch.sparkSession, reference.ids, sink, batch_id)
        current = replace(reference, ids=known)
        rows = named(batch, current, Options(), spec)
        write_version(new_series_ids(known, resolution(rows, current)), sink, batch_id)

    return _start(files, step, checkpoint)


def known_ids(spark: SparkSession, given: DataFrame, sink: str, before: int) -> DataFrame:
    """The given ID table with what the batches before one have learned; no series occurs twice."""
    if before == 0:
        return given
    return given.unionByName(earlier_versions(spark, sink, before, "series_key string, series_id int"))
