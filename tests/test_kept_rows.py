"""What is kept on the way is what later steps read, and no more."""

import pytest
from pyspark.sql import functions as F

from reelspark.checks import queries
from reelspark.operators import ordinals
from reelspark.operators.infer import infer
from reelspark.plans import pipeline

FILES = [("/in/a/Night.Harbor.S01E02.The.Tide.mkv", 1, "file"), ("/in/a/night.harbor.s01e02.the.tide.mkv", 2, "file")]


class Given:
    """Stands in for the inputs of a query."""

    def __init__(self, spark):
        self.spark, self.files = spark, spark.createDataFrame(FILES, "path string, input_ord bigint, path_type string")

    def named(self):
        return infer(self.files)

    def __getitem__(self, name):
        assert name == "listing"
        return self.files.select("path")


@pytest.fixture
def kept(monkeypatch):
    """The columns of each table the numbering and the claims have kept."""
    tables, keep = {}, ordinals._kept

    def spy(rows, label):
        tables.setdefault(label, set(rows.columns))
        return keep(rows, label)

    monkeypatch.setattr(ordinals, "_kept", spy)
    return tables


def test_dest_conflicts_keeps_paths_only(spark, kept):
    got = {r.path: r.claim for r in queries.dest_conflicts(Given(spark)).collect()}
    assert got == {FILES[0][0]: "first", FILES[1][0]: "conflict"}
    assert kept["rows"] == {"path", "input_ord", "target", ordinals.ROW}


def test_rename_action_keeps_paths_only(spark, kept):
    got = {r.path: r.rename_action for r in queries.rename_action(Given(spark)).collect()}
    assert got == {FILES[0][0]: "rename", FILES[1][0]: "conflict"}
    assert kept["rows"] <= {"path", "input_ord", "path_type", "rename_target", "_wanted", ordinals.ROW}


def test_order_tv_keeps_its_order_and_fields(spark, kept):
    assert {r["rank"] for r in queries.order_tv(Given(spark)).collect()} == {1, 2}
    assert kept["given"] == {"path", "series", "series_id", "season", "episode", "title"}


def test_process_keeps_no_raw_parts(spark, kept):
    options = pipeline.Options(fetch=False)
    rows = pipeline.process(Given(spark).files, pipeline.Reference(None, None), options).collect()
    assert {r.path: r.status for r in rows} == {FILES[0][0]: "planned", FILES[1][0]: "conflict"}
    assert "parts" not in kept["rows"]


def test_stream_dedup_makes_its_announcements_once(spark, tmp_path, monkeypatch):
    """Rows with a random mark: whoever deals them out anew for every slice announces some twice or never."""
    once = spark.range(3000).select(
        F.concat(F.lit("/in/"), "id").alias("path"), F.timestamp_seconds(F.lit(1_600_000_000)).alias("seen"),
        F.pmod(F.hash(F.reflect(F.lit("java.util.UUID"), F.lit("randomUUID"))), F.lit(3)).alias("slice"),
    )
    monkeypatch.setattr(queries, "Inputs", lambda *_: {"announcements": once})
    rows = queries.stream_dedup(spark, "").collect()
    assert sorted(r.path for r in rows) == sorted(f"/in/{n}" for n in range(3000))
