"""Plans end to end on small tables, with every outcome present."""

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reelspark import session
from reelspark.operators import assign, enrich, planning, reports
from reelspark.operators.infer import TV
from reelspark.plans import pipeline
from reelspark.plans.pipeline import Options, Reference
from reelspark.plans.registry import processor
from reelspark.sources import catalog, schemas, tables
from reelspark.streaming import arrivals

IN, OUT = "/in/Night Harbor", "/library/Night Harbor/Season 03"
# path, path_type, expected status, rename_action, organize_action
FILES = [
    (f"{IN}/Night.Harbor.S03E04.x.mkv", "file", "planned", "rename", "move"),
    (f"{IN}/night.harbor.304.HDTV.mkv", "file", "conflict", "conflict", "move"),
    (f"{IN}/night.harbor.0304.HDTV.mkv", "file", "conflict", "conflict", "move"),
    (f"{IN}/Night Harbor -03.05- Fog.avi", "file", "planned", "already_named", "move"),
    (f"{IN}/Night.Harbor.S03E06.mkv", "file", "conflict", "conflict", "move"),
    (f"{IN}/Night.Harbor.S03E07.mkv", "absent", "missing", None, None),
    (f"{IN}/Night.Harbor.S03E08.mkv", "directory", "not_a_file", "rename", "not_a_file"),
    (f"{IN}/Night.Harbor.S03E99.own.title.mkv", "file", "planned", "rename", "move"),
    (f"{IN}/Night.Harbor.S00E01.mkv", "file", "no_season", None, None),
    (f"{IN}/Night.Harbor.S01E00.mkv", "file", "no_episode", None, None),
    (f"{IN}/Who.Knows.S01E01.mkv", "file", "no_series_id", None, None),
    (f"{IN}/nothing.mkv", "file", "NO_MATCH", None, None),
    ("", "file", "empty_path", None, None),
    ("/in/b/Night.Harbor.S03E04.mkv", "file", "conflict", "rename", "conflict"),
    (f"{OUT}/Night Harbor -03.07- Ebb.mkv", "file", "planned", "already_named", "in_place"),
]
SHOWS = [(1, "Night Harbor"), (2, "Day Harbor")]
EPISODES = [
    (1, 3, 4, 104, "Low Tide"), (1, 3, 5, 105, "Fog"), (1, 3, 6, 106, "Bell"), (1, 3, 7, 107, "Ebb"),
    (1, 3, 8, 108, "Flow"), (1, 3, 8, 208, "Second entry"), (2, 1, 1, 201, "Dawn"), (2, 1, 2, 202, None),
]


@pytest.fixture(scope="module")
def manifest(spark):
    rows = [(path, i, kind) for i, (path, kind, *_) in enumerate(FILES)]
    return spark.createDataFrame(rows, schemas.MANIFEST)


@pytest.fixture(scope="module")
def listing(spark, manifest):
    extra = spark.createDataFrame([(f"{IN}/Night Harbor -03.06- Bell.mkv",)], "path string")
    return manifest.filter("path_type <> 'absent'").select("path").unionByName(extra)


@pytest.fixture(scope="module")
def reference(spark):
    text = lambda c: F.lit(None).cast("string").alias(c)
    episodes = spark.createDataFrame(
        EPISODES, "series_id int, season int, episode int, episode_id int, title string"
    ).select("*", text("url"), text("summary"))
    shows = spark.createDataFrame(SHOWS, "show_id int, name string").withColumn(
        "show", F.from_json(F.to_json(F.struct(F.col("show_id").alias("id"), "name")), schemas.SHOW)
    )
    seasons = spark.createDataFrame([(1, 0, 31, 3), (1, 1, 32, 3)], "series_id int, ord int, season_id int, season int")
    ids = spark.createDataFrame([("day harbor", 2)], "series_key string, series_id int")
    aliases = spark.createDataFrame([("nite harbor", "Night Harbor")], "variant_key string, preferred string")
    return Reference(ids, catalog.TableCatalog(shows, seasons, episodes), aliases)


def by_path(df, *columns):
    return {r.path: tuple(r[c] for c in columns) for r in df.collect()}


def test_process(manifest, reference, listing):
    plan = pipeline.process(manifest, reference, Options(owner="media"), listing)
    got = by_path(plan, "status", "rename_action", "organize_action")
    assert got == {path: tuple(rest) for path, _, *rest in FILES}
    targets = by_path(plan, "rename_target", "organize_target", "title", "mode", "owner", "group")
    assert targets[f"{IN}/Night.Harbor.S03E04.x.mkv"] == (
        f"{IN}/Night Harbor -03.04- Low Tide.mkv", f"{OUT}/Night Harbor -03.04- Low Tide.mkv", "Low Tide", 420, "media", None,
    )
    # A conflict keeps the old name for the move; an episode nobody knows gets no title.
    assert targets[f"{IN}/Night.Harbor.S03E06.mkv"][1] == f"{OUT}/Night.Harbor.S03E06.mkv"
    assert targets[f"{IN}/Night.Harbor.S03E99.own.title.mkv"][0] == f"{IN}/Night Harbor -03.99- Unknown.mkv"
    assert targets[f"{IN}/nothing.mkv"][:2] == (None, None)


def test_names_are_parsed_no_more_than_needed(manifest, reference, listing):
    """Once, for the table that the rows and the distinct series are both read from."""
    plan = pipeline.process(manifest, reference, Options(), listing)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count(r"S(\d{2})") == 0
    rows = pipeline.named(manifest, reference, Options(), TV)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(r"S(\d{2})") == 1


def test_tables_go_when_nothing_reads_them(spark, manifest, reference, listing, tmp_path, monkeypatch):
    """Of a plan that is not yet written its rows are left, and who won which claim."""
    monkeypatch.setattr(session, "session_dir", lambda _: str(tmp_path / "own"))
    plan = pipeline.process(manifest, reference, Options(), listing)
    assert sorted(name.rsplit("-", 1)[0] for name in os.listdir(tmp_path / "own")) == ["bitmaps", "bitmaps", "rows"]
    assert plan.count() == len(FILES)


def test_report_has_parts_but_keeps_none(manifest, reference, monkeypatch):
    columns, keep = {}, pipeline.kept
    monkeypatch.setattr(pipeline, "kept", lambda table, label: columns.setdefault(label, table.columns) and keep(table, label))
    got = pipeline.infer_report(manifest, reference).collect()
    assert "parts" not in columns["named"]
    named = {r.path: r.parts for r in pipeline.named(manifest, reference, Options(), TV).collect()}
    assert {r.path: r.parts for r in got} == named


def test_claims_are_unique(manifest, reference, listing):
    plan = pipeline.process(manifest, reference, Options(), listing)
    for target, action, word in (("rename_target", "rename_action", "rename"), ("organize_target", "organize_action", "move")):
        moved = plan.filter(F.col(action) == word)
        assert moved.count() == moved.select(target).distinct().count() > 0


def test_toggles(manifest, reference, listing):
    plan = pipeline.process(manifest, reference, Options(fetch=False, organize=False, simulate=True), listing)
    got = by_path(plan, "series_id", "title", "rename_action", "organize_target", "organize_action", "mode")
    assert got[f"{IN}/Night.Harbor.S03E99.own.title.mkv"] == (0, "Own Title", "simulated", None, None, None)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "episode_id" not in text
    options = Options.of({"fetch": False, "mode": "600", "logfile": "x"}, {"fetch": True})
    assert options.fetch and options.mode == "600"


def test_title_policy(manifest, reference):
    path = f"{IN}/Night.Harbor.S03E99.own.title.mkv"
    for policy, title in (("overwrite", ""), ("fill", "Own Title")):
        rows = pipeline.infer_report(manifest, reference, Options(title_policy=policy))
        assert by_path(rows, "title", "fetch_status")[path] == (title, "episode_not_found")
    with pytest.raises(ValueError):
        pipeline.infer_report(manifest, reference, Options(title_policy="other"))


def test_registry(manifest, reference, listing):
    run = processor("tv", reference.catalog, reference.ids, reference.aliases)
    assert run.process(manifest, None, listing).count() == len(FILES)
    assert run.infer(manifest).count() == len(FILES)
    with pytest.raises(KeyError):
        processor("film", reference.catalog, reference.ids)


def test_outcome_counts(manifest, reference, listing):
    plan = pipeline.process(manifest, reference, Options(), listing)
    rows = planning.outcome_counts(plan, {"plan": "status", "rename": "rename_action"}).collect()
    assert sum(r.n for r in rows if r.stage == "plan") == len(FILES)
    assert {r.status: r.n for r in rows}["conflict"] >= 2


def test_outcomes_are_counted_while_the_plan_is_written(spark, manifest, reference, listing, tmp_path):
    plan = pipeline.process(manifest, reference, Options(), listing)
    columns = {stage: column for stage, (column, _) in planning.OUTCOMES.items()}
    expected = sorted(tuple(r) for r in planning.outcome_counts(plan, columns).collect())
    rows, counts = planning.observed(plan)
    tables.write_plan(rows, str(tmp_path / "plan"))
    assert sorted(tuple(r) for r in planning.observed_counts(spark, counts).collect()) == expected
    odd, counts = planning.observed(plan.withColumn("status", F.lit("unheard of")))
    odd.collect()
    found = {(r.stage, r.status): r.n for r in planning.observed_counts(spark, counts).collect()}
    assert found["plan", "other"] == len(FILES)


def test_season_ids(spark, reference):
    rows = spark.createDataFrame([(1, 3), (1, 4), (9, 1), (None, 3)], "series_id int, season int")
    got = {(r.series_id, r.season): r.season_id for r in enrich.season_id(rows, reference.catalog.seasons()).collect()}
    assert got == {(1, 3): 31, (1, 4): 0, (9, 1): 0, (None, 3): 0}


REQUESTS = [
    (1, "day harbor", 0, 1, 1, "ok", "episode"), (2, "Day Harbor", 0, 1, 0, "ok", "season"),
    (3, "", 1, 0, 0, "ok", "series"), (4, "x", 1, 0, 0, "series_and_series_id", "none"),
    (5, None, None, 1, 1, "no_series", "none"), (6, "x", 0, 0, 4, "episode_without_season", "none"),
    (7, "zzz", 0, 0, 0, "nothing_found", "none"), (8, "", 1, 3, 44, "episode_not_found", "episode"),
    (9, "", 1, 44, 0, "season_not_found", "season"), (10, "", 77, 0, 0, "series_not_found", "series"),
    (11, "night harbr", 0, 3, 4, "ok", "episode"),
]


def test_fetch_report(spark, reference):
    asked = spark.createDataFrame(
        [r[:5] for r in REQUESTS], "request_id int, series string, series_id int, season int, episode int"
    )
    rows = pipeline.fetch_report(asked, reference).orderBy("part").collect()
    got = {r.request_id: r for r in reversed(rows)}
    assert {i: (r.status, r.granularity) for i, r in got.items()} == {r[0]: r[5:] for r in REQUESTS}
    assert got[1].text == "1x1 - Dawn\nNone\n" and got[11].text.startswith("3x4 - Low Tide")
    assert [(r.part, r.text) for r in rows if r.request_id == 2] == [(1, "1x1 - Dawn\nNone\n"), (2, "1x2 - None\nNone\n")]
    assert got[3].text == "Night Harbor - ID: 1 - None\nPremiered: None - Status: None\n"


def test_fetch_report_raw(spark, reference):
    """Untouched JSON at every granularity; what is not found, and why, is as in the text form."""
    show = '{"id": 1,  "name":"Night Harbor", "_links": {"a":[1]}}'
    episode = '{"id": %d, "season":%d,"number": %d,  "name":"x", "_links":null}'
    shows = spark.createDataFrame([(show,), ("no json",)], "payload string")
    seasons = spark.createDataFrame([], "series_id int, payload string")
    records = [(e[0], episode % (e[3], e[1], e[2])) for e in EPISODES]
    episodes = spark.createDataFrame([*records, (1, "no json"), (1, None)], "series_id int, payload string")
    held = replace(reference, catalog=catalog.PayloadCatalog(shows, seasons, episodes), index=reference.search_index())
    asked = spark.createDataFrame(
        [r[:5] for r in REQUESTS] + [(12, "", 1, 3, 8)], "request_id int, series string, series_id int, season int, episode int"
    )
    raw = pipeline.fetch_report(asked, held, raw=True).collect()
    text = pipeline.fetch_report(asked, reference).collect()
    outcome = lambda rows: sorted((r.request_id, r.granularity, r.part, r.status) for r in rows)
    assert outcome(raw) == outcome(text)
    got = {(r.request_id, r.part): r.text for r in raw}
    assert got[3, 1] == show and got[1, 1] == episode % (201, 1, 1) and got[12, 1] == episode % (108, 3, 8)
    assert [got[2, 1], got[2, 2]] == [episode % (201, 1, 1), episode % (202, 1, 2)]


def test_season_is_a_row_per_episode(spark, reference):
    whole = reports.season_text(reference.catalog.episodes()).filter("series_id = 1").first().text
    rows = reports.season_report(reference.catalog.episodes()).filter("series_id = 1").orderBy("idx").collect()
    assert [r.idx for r in rows] == [1, 2, 3, 4, 5, 6] and "\n\n".join(r.text for r in rows) == whole


def test_slashes_and_duplicate_keys(spark, reference):
    """A slash in a title gives no target, duplicate keys no second row, a trailing slash no blind spot."""
    path = f"{IN}/Night.Harbor.S03E04.mkv"
    manifest = spark.createDataFrame([(path, 0, "file"), (f"{IN}/Night.Harbor.S03E05.mkv", 1, "file")], schemas.MANIFEST)
    episodes = reference.catalog.episodes().withColumn("title", F.when(F.col("episode") == 4, "Part 1/2").otherwise(F.col("title")))
    given = catalog.TableCatalog(reference.catalog.shows(), reference.catalog.seasons(), episodes)
    ids = tables.series_id_table(
        spark.createDataFrame([(1, "Night Harbor", "7"), (2, "night harbor ", "1"), (0, "x", "n/a")], "line int, series string, id string"), ("line",)
    )
    aliases = tables.alias_table(spark.createDataFrame([("Nite", "A"), ("nite", "B")], "variant string, preferred string"))
    assert sorted(r[:] for r in ids.collect()) == [("night harbor", 1), ("x", 0)]
    assert [r[:] for r in aliases.collect()] == [("nite", "B")]
    listing = manifest.select("path").unionByName(spark.createDataFrame([(f"{OUT}/Night Harbor -03.05- Fog.mkv",)], "path string"))
    for library in ("/library", "/library/"):
        plan = pipeline.process(manifest, Reference(ids, given, aliases), Options(library=library), listing)
        assert by_path(plan, "status", "rename_target", "organize_target", "organize_action") == {
            path: ("invalid_name", None, None, None),
            f"{IN}/Night.Harbor.S03E05.mkv": ("conflict", f"{IN}/Night Harbor -03.05- Fog.mkv", f"{OUT}/Night Harbor -03.05- Fog.mkv", "conflict"),
        }


def test_apply(spark, reference):
    asked = spark.createDataFrame(
        [(1, "night HARBOR", 3, 4), (2, "Night Harbor", 3, 0), (3, "Night Harbor", 3, 4), (4, "", 1, 0),
         (5, "zzz", 1, 0), (6, "Night Harbor", 3, 77), (7, "Night Harbor", 0, 4), (8, "Night Harbor", 9, 0)],
        "request_id int, series string, season int, episode int",
    )
    names = [(1, "in/a.mkv"), (2, "in/10 x.mkv"), (2, "in/9 x.mkv"), (2, "in/b.mkv"), (3, "in/c.mkv"),
             (3, "in/d.mkv"), (4, "in/e.mkv"), (5, "in/f.mkv"), (6, "in/g.mkv"), (8, "in/h.mkv")]
    files = spark.createDataFrame(names, "request_id int, path string")
    reasons = {r.request_id: r.reason for r in pipeline.accepted_assignments(asked, files, reference).collect()}
    assert reasons == {1: None, 2: None, 3: "not_one_file", 4: "no_series", 5: "no_series_id", 6: None,
                       7: "episode_without_season", 8: None}
    got = by_path(pipeline.apply(files, asked, reference), "rename_target", "status")
    assert got == {
        "in/a.mkv": ("in/night HARBOR -03.04- Low Tide.mkv", "fetched"),
        "in/b.mkv": ("in/Night Harbor -03.04- Low Tide.mkv", "paired"),
        "in/9 x.mkv": ("in/Night Harbor -03.05- Fog.mkv", "paired"),
        "in/10 x.mkv": ("in/Night Harbor -03.06- Bell.mkv", "paired"),
        "in/g.mkv": ("in/Night Harbor -03.77- Unknown.mkv", "episode_not_found"),
        "in/c.mkv": (None, "not_one_file"), "in/d.mkv": (None, "not_one_file"), "in/e.mkv": (None, "no_series"),
        "in/f.mkv": (None, "no_series_id"), "in/h.mkv": (None, "no_episode_left"),
    }


def test_apply_settles_claims(spark, reference):
    asked = spark.createDataFrame(
        [(1, "Night Harbor", 3, 4), (2, "Night Harbor", 3, 4), (3, "Night Harbor", 3, 5), (4, "Night Harbor", 3, 6)],
        "request_id int, series string, season int, episode int",
    )
    there = "in/Night Harbor -03.06- Bell.mkv"
    files = spark.createDataFrame(
        [(1, "in/z.mkv"), (2, "in/a.mkv"), (3, "in/b.mkv"), (4, there)], "request_id int, path string"
    )
    listing = spark.createDataFrame([("in/Night Harbor -03.05- Fog.mkv",), (there,)], "path string")
    got = by_path(pipeline.apply(files, asked, reference, listing), "rename_action")
    assert got == {"in/z.mkv": ("rename",), "in/a.mkv": ("conflict",), "in/b.mkv": ("conflict",), there: ("already_named",)}


def test_learned_ids(manifest, reference, tmp_path):
    path = str(tmp_path / "learned")
    pipeline.infer_report(manifest, reference, Options(learned=path))
    ids = manifest.sparkSession.read.parquet(path)
    assert {tuple(r) for r in ids.collect()} == {("day harbor", 2), ("night harbor", 1)}


def test_natural_order(spark):
    rows = spark.createDataFrame([("10.mkv",), ("9.mkv",), ("1 b.mkv",), ("1 a.mkv",), ("z.mkv",)], "n string")
    got = [r.n for r in rows.orderBy(*assign.natural_key(F.col("n"))).collect()]
    assert got == ["z.mkv", "1 a.mkv", "1 b.mkv", "9.mkv", "10.mkv"]
    long = [f"{'9' * 40} a.mkv", f"1{'0' * 40}.mkv", f"{'0' * 50}7.mkv", "8.mkv", f"{'9' * 40} b.mkv"]
    rows = spark.createDataFrame([(n,) for n in long], "n string")
    got = [r.n for r in rows.orderBy(*assign.natural_key(F.col("n"))).collect()]
    assert got == [long[2], long[3], long[0], long[4], long[1]]


# Sources, sinks and streams -------------------------------------------------------------


def test_manifests(spark, manifest, tmp_path):
    usable = manifest.filter("path <> ''")
    for form in ("parquet", "csv", "json"):
        writer = usable.write.format(form)
        (writer.option("header", True) if form == "csv" else writer).save(str(tmp_path / form))
        got = tables.read_manifest(spark, str(tmp_path / form), form)
        assert sorted(got.collect()) == sorted(usable.collect())
    usable.select("path").write.text(str(tmp_path / "text"))
    got = tables.read_manifest(spark, str(tmp_path / "text"), "text")
    assert got.columns == usable.columns and got.count() == usable.count()


def test_text_manifests_keep_their_order(spark, tmp_path):
    """Lines over several files and splits are numbered as they stand."""
    lines = [f"/in/{(i * 7919) % 4001:04d}/name {i}.mkv" for i in range(4000)]
    for n in range(4):
        (tmp_path / f"part{n}.txt").write_text("".join(f"{x}\n" for x in lines[n * 1000 : (n + 1) * 1000]))
    settings = {"spark.sql.files.maxPartitionBytes": "9k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = tables.read_manifest(spark, str(tmp_path), "text").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.input_ord, r.path) for r in found) == list(enumerate(lines, 1))


def test_list_files(spark, tmp_path):
    for name in ("a/Night Harbor 0304 - x.mkv", "b.mkv", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    found = tables.list_files(spark, str(tmp_path), "*.mkv")
    assert sorted(r.path for r in found.collect()) == sorted(
        str(tmp_path / n) for n in ("a/Night Harbor 0304 - x.mkv", "b.mkv")
    )
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_json_catalog(spark, tmp_path):
    lines = {
        "shows": [{"id": 1, "name": "A", "network": {"name": "N", "country": None}, "genres": ["x"]}],
        "seasons": [{"series_id": 1, "ord": 0, "id": 10, "number": 3, "premiereDate": None}],
        "episodes": [{"series_id": 1, "id": 100, "name": "T", "season": 3, "number": 4, "airdate": "2001-02-03",
                      "airstamp": "2001-02-03T04:05:06+00:00", "_links": {}}],
    }
    for name, rows in lines.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("\n".join(map(json.dumps, rows)))
    snapshot = catalog.JsonCatalog(spark, str(tmp_path))
    assert snapshot.raw_shows().first()[:] == (1, json.dumps(lines["shows"][0]))
    assert snapshot.raw_episodes().first()[:] == (1, 3, 4, 100, json.dumps(lines["episodes"][0]))
    assert snapshot.shows().first().show.network.name == "N"
    assert snapshot.seasons().select("series_id", "ord", "season_id", "season").first()[:] == (1, 0, 10, 3)
    row = snapshot.episodes().first()
    assert (row.series_id, row.season, row.episode, row.title, str(row.air_date)) == (1, 3, 4, "T", "2001-02-03")


def test_sinks(spark, manifest, reference, listing, tmp_path):
    plan = pipeline.process(manifest, reference, Options(), listing)
    tables.write_plan(plan, str(tmp_path / "plan"))
    assert (tmp_path / "plan" / "status=planned").is_dir()
    assert spark.read.parquet(str(tmp_path / "plan")).count() == len(FILES)
    root = str(tmp_path / "ids")
    first = tables.write_version(reference.ids, root, 0)
    merged = tables.merge_series_ids(
        spark.read.parquet(first), spark.createDataFrame([("n", 1)], "series_key string, series_id int")
    )
    for _ in range(2):
        assert spark.read.parquet(tables.write_version(merged, root, 1)).count() == 2
    assert spark.read.parquet(first).count() == 1


@pytest.fixture(scope="module")
def arrivals_dir(manifest, tmp_path_factory):
    """The manifest as four files that land one after the other."""
    folder = tmp_path_factory.mktemp("arrivals")
    for i in range(4):
        manifest.filter((F.col("input_ord") >= i * 4) & (F.col("input_ord") < i * 4 + 4)).coalesce(1).write.mode(
            "append"
        ).parquet(str(folder))
    return str(folder)


def test_stream_is_batch(spark, manifest, reference, listing, arrivals_dir, tmp_path):
    files = arrivals.manifest_stream(spark, arrivals_dir, 1)
    sink = str(tmp_path / "sink")
    arrivals.stream_plan(files, reference, sink, str(tmp_path / "state"), Options(), listing).awaitTermination()
    streamed = spark.read.parquet(sink)
    assert streamed.select("version").distinct().count() == 4
    given = spark.read.parquet(f"{sink}-claims/rename/granted").select("path").collect()
    renamed = streamed.filter("rename_action = 'rename'").select("rename_target").collect()
    assert sorted(r[0] for r in given) == sorted(r[0] for r in renamed)
    batch = pipeline.process(manifest, reference, Options(), listing)
    assert sorted(map(str, streamed.drop("version").collect())) == sorted(map(str, batch.collect()))
    # Nothing new: a second start plans nothing again.
    arrivals.stream_plan(files, reference, sink, str(tmp_path / "state"), Options(), listing).awaitTermination()
    assert spark.read.parquet(sink).count() == len(FILES)


def test_stream_works_its_tables_out_once(spark, manifest, reference, listing, arrivals_dir, tmp_path, monkeypatch):
    """Not anew for each batch: they are kept before the first one."""
    labels, keep = [], arrivals.kept

    def spy(table, label):
        labels.append(label)
        return keep(table, label)

    monkeypatch.setattr(arrivals, "kept", spy)
    monkeypatch.setattr(pipeline, "kept", spy)
    files = arrivals.manifest_stream(spark, arrivals_dir, 1)
    arrivals.stream_plan(files, reference, str(tmp_path / "plan"), str(tmp_path / "state"), Options(), listing).awaitTermination()
    assert labels.count("named") > 1
    assert all(labels.count(label) == 1 for label in ("listing", "ids", "index", "episodes"))


def test_claims_are_keyed_state(spark, tmp_path):
    """Ten batches: each path goes to the first that asks; a batch that runs again gets its own answer."""
    root, seen = str(tmp_path / "claims"), set()
    ask = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    got = lambda table: sorted(r.path for r in table.collect())
    answers = []
    for n in range(10):
        paths = [f"/p/{(n * 60 + i) % 350}" for i in range(100)]
        granted = got(arrivals.KeyedClaims(root).grant(ask([*paths, paths[0], None]), n))
        assert granted == sorted(set(paths) - seen)
        seen |= set(paths)
        answers.append(granted)
    # A batch that runs again gets its own answer, and no path it had not asked for.
    assert got(arrivals.KeyedClaims(root).grant(ask(["/p/0", "/new"]), 9)) == answers[9]
    assert got(arrivals.KeyedClaims(root).grant(ask(["/p/0", "/new"]), 10)) == ["/new"]
    assert got(arrivals.KeyedClaims(root).grant(ask([]), 11)) == []


def test_claims_survive_a_lost_answer(spark, tmp_path, monkeypatch):
    """A crash while the answer is written: the state goes back to the batch before and answers again."""
    root = str(tmp_path / "claims")
    ask = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    arrivals.KeyedClaims(root).grant(ask("a", "b"), 0)
    start = arrivals._start

    def crash(files, step, checkpoint):
        def half(batch, batch_id):
            batch.count()
            raise RuntimeError("lost")

        return start(files, half, checkpoint)

    monkeypatch.setattr(arrivals, "_start", crash)
    with pytest.raises(Exception, match="lost"):
        arrivals.KeyedClaims(root).grant(ask("b", "c"), 1)
    monkeypatch.undo()
    assert [r.path for r in arrivals.KeyedClaims(root).grant(ask("b", "c"), 1).collect()] == ["c"]


def test_stream_learns_ids(spark, reference, arrivals_dir, tmp_path):
    sink = str(tmp_path / "ids")
    files = arrivals.manifest_stream(spark, arrivals_dir, 1)
    arrivals.stream_learn_ids(files, reference, sink, str(tmp_path / "state")).awaitTermination()
    whole = arrivals.known_ids(spark, reference.ids, sink, 4)
    assert sorted(r[:] for r in whole.collect()) == [("day harbor", 2), ("night harbor", 1)]
    learned = spark.read.parquet(sink).select("series_key", "series_id")
    assert learned.count() + reference.ids.count() == 2  # each version holds its new IDs only


def test_late_rows_are_set_aside(spark, tmp_path):
    """Over three runs with one checkpoint, every announcement is in time or in the table of late ones."""
    columns, day = "path string, t timestamp", "2024-01-%02d 0%d:00:00"
    batches = [
        [("a", day % (1, 0)), ("a", day % (1, 1)), ("b", day % (5, 0))],
        [("a", day % (5, 1)), ("c", day % (3, 0)), ("d", day % (4, 1)), ("e", None)],  # the watermark is the 4th, 0:00
        [("b", day % (5, 0)), ("f", day % (4, 1)), ("c", day % (4, 1)), ("g", day % (4, 2))],  # now the 4th, 1:00
    ]
    root, sink = str(tmp_path / "split"), str(tmp_path / "sink")
    for rows in batches:
        spark.createDataFrame(rows, "path string, t string").selectExpr("path", "cast(t as timestamp) t").coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
        arrivals.split_late(stream, "t", "1 day", root, str(tmp_path / "state")).awaitTermination()
        once = arrivals.dedup_arrivals(arrivals.timely(spark, root, columns), "t", "1 day").writeStream.format("parquet")
        once.option("path", sink).option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start().awaitTermination()
    late = sorted((r.version, r.path) for r in arrivals.late_rows(spark, root, columns).collect())
    assert late == [(1, "c"), (1, "e"), (2, "c"), (2, "f")]
    assert spark.read.parquet(root).count() == sum(map(len, batches))
    assert sorted(r.path for r in spark.read.parquet(sink).collect()) == ["a", "a", "b", "d", "g"]


def test_stream_dedup(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:05:00")], "path string, t string"
    ).withColumn("t", F.col("t").cast("timestamp"))
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        arrivals.dedup_arrivals(stream, "t", "1 hour").writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
