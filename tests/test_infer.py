"""Reading file names."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reelspark.checks import inputs
from reelspark.operators.infer import NO_PATTERNS, TV, MediaSpec, Shape, infer, match_shapes, metadata_struct, tv_fields

# filename, shape, series, season, episode, title
CASES = [
    ("Night.Harbor.S03E04.Low.Tide.HDTV.XviD-AAA.avi", 1, "Night Harbor", 3, 4, "Low Tide"),
    ("night.harbor.s03e04.low.tide.hdtv.avi", 1, "Night Harbor", 3, 4, "Low Tide"),
    ("Night.Harbor.S03E04.HDTV.avi", 1, "Night Harbor", 3, 4, ""),
    ("Night.Harbor.S03.E04.mp4", 1, "Night Harbor", 3, 4, ""),
    ("Night.Harbor.(2011).S03E04.Low.Tide.720p.WEB-X.mp4", 1, "Night Harbor", 3, 4, "Low Tide"),
    ("Night.Harbor.2011.S03E04.Low.Tide.HDTV.mp4", 1, "Night Harbor", 3, 4, "Low Tide"),
    ("Night.Harbor.S01E02.E07.Signal.720p.mkv", 1, "Night Harbor", 1, 2, "E07 Signal"),
    ("Night.Harbor.2021.S02E08.Back.in.1602.1080p.H.264-Z.mkv", 1, "Night Harbor", 2, 8, "Back In 1602"),
    ("night.harbor.(2011).304.low.tide.hdtv.mp4", 2, "Night Harbor", 3, 4, "Low Tide"),
    ("Night.Harbor.2011.304.Low.Tide.HDTV.mp4", 2, "Night Harbor", 3, 4, "Low Tide"),
    ("night.harbor.1104.low.tide.hdtv-x[y].mp4", 3, "Night Harbor", 11, 4, "Low Tide"),
    ("a.dir.1104/night.harbor.1104.low.tide.mp4", 3, "Night Harbor", 11, 4, "Low Tide"),
    ("Night.Harbor.S0304.The.Keeper's.Lamp.HDTV.avi", 3, "Night Harbor", 3, 4, "The Keeper's Lamp"),
    ("Night Harbor -03.04- Low Tide.avi", 4, "Night Harbor", 3, 4, "Low Tide"),
    ("Night Harbor -304- Low Tide.avi", 5, "Night Harbor", 3, 4, "Low Tide"),
    ("Night Harbor 0304 - Low Tide.mkv", 5, "Night Harbor", 3, 4, "Low Tide"),
    ("Night Harbor S03E04 low tide in the bay (1080p x265 Zed).mkv", 6, "Night Harbor", 3, 4, "Low Tide In The Bay"),
    ("night harbor s03e04 low tide.mkv", None, "", 0, 0, ""),
    ("Night.Harbor.12.mp4", None, "", 0, 0, ""),
    ("Night.Harbor.mp4", None, "", 0, 0, ""),
    ("Night.Harbor.1080p.Rip.mkv", 3, "Night Harbor", 10, 80, "P Rip"),
    ("harbor's.end.S01E02.x.mkv", 1, "Harbor'S End", 1, 2, "X"),
    ("Night.Harbor.S01E03.The.Web.Below.mkv", 1, "Night Harbor", 1, 3, "The"),
    ("Été.à.la.mer.S01E02.Le.début.mkv", 1, "Été À La Mer", 1, 2, "Le Début"),
    ("night.harbor.S٠١E٠٢.x.mkv", 1, "Night Harbor", 1, 2, "X"),
    ("Night.Harbor.S01E02.x.mkv\n", None, "", 0, 0, ""),
    ("﷐1﷐x.S01E02.y.mkv", 1, "�1�X", 1, 2, "Y"),
]


def test_cases(spark):
    files = spark.createDataFrame([(c[0],) for c in CASES], "path string")
    got = {
        r.path: r[:]
        for r in infer(files).select("path", "parts.shape", "series", "season", "episode", "title").collect()
    }
    for case in CASES:
        assert got[case[0]] == case


def test_raw_parts(spark):
    files = spark.createDataFrame([("A.(2011).S03E04.t.mkv",), ("A.104.t.mkv",), ("zzz",)], "path string")
    rows = {r.path: r.parts for r in infer(files).select("path", "parts").collect()}
    assert rows["A.(2011).S03E04.t.mkv"][:] == (1, "A", "(2011)", "03", "04", "t", "mkv")
    assert rows["A.104.t.mkv"][:] == (3, "A", "", "1", "04", "t", "mkv")
    assert rows["zzz"] is None


def test_metadata_struct(spark):
    files = spark.createDataFrame([("A.S03E04.t.mkv",)], "path string")
    assert infer(files).select(metadata_struct()).first()[0][:] == ("A", 3, 4, "T")


def test_other_media_types(spark):
    bare = MediaSpec("bare", (), tv_fields, TV.display, TV.folder)
    files = spark.createDataFrame([("A.S03E04.t.mkv",)], "path string")
    row = infer(files, bare).first()
    assert (row.infer_status, row.series, row.parts) == (NO_PATTERNS, "", None)
    own = MediaSpec("own", (Shape(r"^(.+)_(\d+)\z", ("series", "episode")),), tv_fields, TV.display, TV.folder)
    row = infer(spark.createDataFrame([("abc_7",)], "path string"), own).first()
    assert (row.series, row.episode, row.season) == ("Abc", 7, 0)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_round_trip(spark, scale):
    """Names made of known values give these values back."""
    files = inputs.view(spark, f"/root/testdata/{scale}", "files")
    wrong = infer(files).filter(
        (F.col("series") != F.col("true_series"))
        | (F.col("season") != F.col("true_season"))
        | (F.col("episode") != F.col("true_episode"))
        | (F.col("title") != F.col("true_title"))
    )
    assert wrong.count() == 0


def test_names_are_parsed_once(spark):
    """Each pattern occurs once in the plan, whatever is built on the fields."""
    files = spark.range(1).select(F.concat(F.lit("a"), "id").alias("path"))
    from reelspark.operators.resolve import series_keys

    plan = series_keys(infer(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"S(\d{2})") == 1


def test_shapes_are_one_replacement(spark):
    """All shapes are tried in one pass over a name; a shape that refers to a group is not merged, with the same results."""
    files = spark.createDataFrame([(c[0],) for c in CASES] + [("abb.x",), ("",), (None,)], "path string")
    merged = infer(files).select("path", "infer_status", "parts", "series", "title")
    steps = match_shapes(files, TV.shapes)
    assert steps._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    again = replace(TV, shapes=(*TV.shapes, Shape(r"(?Ud)^(.+)(b)\2\.(.+)\z", ("series", "episode", "extension"))))
    chained = infer(files, again).select("path", "infer_status", "parts", "series", "title")
    key = lambda row: str(row.path)
    rows, others = (sorted(x.collect(), key=key) for x in (merged, chained))
    assert [r for r in rows if r.path != "abb.x"] == [r for r in others if r.path != "abb.x"]
    assert {r.path: r.parts and r.parts.shape for r in others}["abb.x"] == 7
