"""Numbering and claims, with one group holding a third of the rows."""

import os
import time

from pyspark.sql import functions as F

from reelspark import session
from reelspark.operators import assign, ordinals
from reelspark.operators.ordinals import first_claims, number_rows, with_row


def skewed(spark, n=3000):
    """Every third row falls into group 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1).alias("grp"),
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("key"),
        "id",
    )


def expected(rows):
    places, out = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (str(r.grp), r.key, r.id)):
        places[r.grp] = places.get(r.grp, 0) + 1
        out[r.id] = places[r.grp]
    return out


def test_groups_of_any_size(spark):
    rows = skewed(spark)
    got = number_rows(rows, [F.col("key"), F.col("id")], ["grp"], "n")
    assert {r.id: r.n for r in got.collect()} == expected(rows)
    assert got.columns == ["grp", "key", "id", "n"]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_null_group(spark):
    rows = skewed(spark).withColumn("grp", F.nullif("grp", F.lit(0)))
    got = number_rows(rows, [F.col("key"), F.col("id")], ["grp"], "n")
    assert {r.id: r.n for r in got.collect()} == expected(rows)


def test_overall(spark):
    rows = skewed(spark)
    got = number_rows(rows, [F.col("key").desc(), F.col("id")], name="n").collect()
    ordered = sorted(got, key=lambda r: r.n)
    assert [r.n for r in ordered] == list(range(1, 3001))
    assert [(-r.key, r.id) for r in ordered] == sorted((-r.key, r.id) for r in got)


def test_nothing_to_number(spark):
    rows = skewed(spark).filter("id < 0")
    assert number_rows(rows, [F.col("id")], name="n").count() == 0
    assert number_rows(rows, [F.col("id")], ["grp"], "n").count() == 0


def test_first_claims(spark):
    rows = skewed(spark).withColumn("want", F.when(F.col("grp") != 5, F.concat(F.lit("t"), "grp")))
    taken = spark.createDataFrame([("t7",), ("t7",), ("nobody",)], "gone string")
    got = first_claims(with_row(rows), "want", [F.col("key"), F.col("id")], "won", taken).collect()
    assert len(got) == 3000
    best = {}
    for r in got:
        if r.want is not None and r.want != "t7":
            best[r.want] = min(best.get(r.want, (r.key, r.id)), (r.key, r.id))
    for r in got:
        wanted = None if r.want is None else best.get(r.want) == (r.key, r.id)
        assert r.won is wanted


def test_equal_claims_have_one_winner(spark):
    """The same file listed twice: one row wins, whatever the order says."""
    rows = with_row(spark.createDataFrame([("t", 0, "a")] * 3 + [("t", 1, "b"), (None, 0, "c")], "want string, ord int, path string"))
    got = first_claims(rows, "want", [F.col("ord"), F.col("path")], "won").collect()
    assert sorted((r.path, str(r.won)) for r in got) == [("a", "False"), ("a", "False"), ("a", "True"), ("b", "False"), ("c", "None")]


def test_hot_target_is_spread(spark):
    """No task gets more than a small part of a hot target."""
    rows = with_row(spark.range(20_000).select(F.lit("one").alias("want"), "id"))
    claimed = first_claims(rows, "want", [F.col("id")], "won")
    assert claimed.filter("won").count() == 1
    parts = claimed.select(F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in parts.groupBy("p").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 5_000


def test_winners_are_marked_where_the_rows_are(spark, monkeypatch):
    """By bitmaps, so that the rows do not move, and by number where there are too many of them: the same flags."""
    rows = with_row(spark.range(0, 70_000, 1, 2).select((F.col("id") % 50_000).alias("want"), "id"))
    found = []
    for most in (ordinals.BITMAPS, 0):
        monkeypatch.setattr(ordinals, "BITMAPS", most)
        claimed = first_claims(rows, "want", [F.col("id")], "won")
        found.append({r.id: r.won for r in claimed.collect()})
        plan = claimed._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" in plan) == (most == 0)
    assert found[0] == found[1] == {n: n < 50_000 for n in range(70_000)}


def test_shuffles_go_with_their_job(spark):
    """What a table was shuffled by is not left on the disks once the table is written."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [folder.getPath() for folder in env.blockManager().diskBlockManager().localDirs()]
    left = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = left()
    assert session.kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    for _ in range(100):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before


def test_scratch_tables_can_go(spark, monkeypatch):
    """A table is discarded by its files; clearing takes the folder of the application, and no more."""
    own = session.shared_dir(spark) + "/own"
    monkeypatch.setattr(session, "session_dir", lambda _: own)
    one, two = with_row(spark.range(3)), with_row(spark.range(4))
    session.discard(one)
    local = own.removeprefix("file:")
    assert two.count() == 4 and len(os.listdir(local)) == 1
    session.clear_scratch(spark)
    assert not os.path.exists(local)


def test_natural_keys_are_columns(spark, monkeypatch):
    """A sort works its expressions out anew for every comparison, so the keys are columns by then."""
    orders = []

    def seen(rows, order, *more):
        orders.extend(map(str, order))
        return number_rows(rows, order, *more)

    monkeypatch.setattr(assign, "number_rows", seen)
    names = ["10 a", "9 b", "009 a", "x", None, "9 a"]
    files = spark.createDataFrame([(1, name and f"/in/{name}") for name in names], "request_id int, path string")
    got = assign.apply_ordinals(files)
    assert got.columns == ["request_id", "path", "idx"]
    assert [r.path and r.path[4:] for r in got.orderBy("idx").collect()] == [None, "x", "009 a", "9 a", "9 b", "10 a"]
    assert orders and not [order for order in orders if "regexp" in order or "substring" in order]
