"""Aliases, IDs, search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import resolve
from reelspark.session import tune
from reelspark.sources import tables

NAMES = [
    (5, "Night Harbor"), (2, "night harbor"), (3, "Night Harbor US"), (4, "Nigth Harbor"), (6, "Night Harbour"),
    (7, "Harbor"), (8, "The The"), (9, "the"), (10, "a b"), (11, "b"), (12, "Devil's Lamp"), (13, "aaa"), (14, "---"),
]
ASKED = ["night harbor", "Night.Harbor.US", "night", "harbor", "the the the", "aab", "aa", "b", "ab", "devils lamp", "zzz", ""]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def key(name):
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower().replace("'", "")).split())


def brute_force(queries, names, similarity=resolve.SIMILARITY):
    """Every query beside every distinct name."""
    out = {}
    for q, n in itertools.product({key(q) for q in queries} - {""}, {key(n) for _, n in names} - {""}):
        qw, nw = q.split(), n.split()
        fewer = lambda w: [w[:i] + w[i + 1:] for i in range(len(w))] if len(w) > 1 else []
        scores = []
        if q == n:
            scores.append(1.0)
        if levenshtein(q, n) == 1:
            scores.append(1 - 1 / max(len(q), len(n)))
        if nw in fewer(qw) or qw in fewer(nw):
            scores.append(1 - 1 / max(len(qw), len(nw)))
        if q != n and q.replace(" ", "") == n.replace(" ", ""):
            scores.append(1 - 1 / max(len(q), len(n)))
        share = len({*qw} & {*nw}) / len({*qw} | {*nw})
        if q != n and share >= similarity:
            scores.append(min(share, 1 - 1 / (max(len(qw), len(nw)) + 1)))
        if scores:
            ids = [i for i, m in names if key(m) == n]
            out[q, n] = (round(max(scores), 6), min(ids), len(ids))
    return out


def search(spark, asked=ASKED, names=NAMES):
    queries = spark.createDataFrame([(a,) for a in asked], "query string")
    index = resolve.name_index(spark.createDataFrame(names, "show_id int, name string"))
    return queries, index, resolve.search_candidates(queries, index)


def test_search_is_brute_force(spark):
    _, _, found = search(spark)
    got = {(r.query_key, r.name_key): (r.score, r.show_id, r.n_shows) for r in found.collect()}
    assert got == brute_force(ASKED, NAMES)
    assert got["night harbor", "night harbor"] == (1.0, 2, 2)


def test_several_words_apart(spark):
    names = [(1, "The Office Us Archive"), (2, "Agents Of S.H.I.E.L.D"), (3, "Lost"), (4, "The Lost Archive Of The Us")]
    asked = ["office archive", "archive us office the", "agents of shield", "lost of", "us lost archive"]
    _, _, found = search(spark, asked, names)
    got = {(r.query_key, r.name_key): (r.score, r.show_id, r.n_shows) for r in found.collect()}
    assert got == brute_force(asked, names)
    assert ("office archive", "the office us archive") in got and ("archive us office the", "the office us archive") in got
    assert ("agents of shield", "agents of s h i e l d") in got


def test_word_pairs_at_other_thresholds(spark):
    """Random names of a few words; every threshold agrees with comparing all pairs."""
    random.seed(5)
    made = sorted({" ".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(120)})
    asked = spark.createDataFrame([(n,) for n in made[::2]], "query_key string")
    index = spark.createDataFrame([(n, i, 1) for i, n in enumerate(made)], "name_key string, show_id int, n_shows long")
    share = lambda a, b: len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()})
    for threshold in (0.3, 0.5, 2 / 3, 0.8, 1.0):
        got = [(r.query_key, r.name_key) for r in resolve.word_pairs(asked, index, threshold).collect()]
        assert sorted(got) == sorted((a, b) for a in made[::2] for b in made if a != b and share(a, b) >= threshold)


@pytest.mark.parametrize("similarity", [0.4, 0.5, 0.75])
def test_search_at_any_threshold_is_brute_force(spark, similarity):
    """Short words, so that a letter, a blank or a repeated word also makes pairs, and names beyond the paired keys."""
    rng = random.Random(9)
    made = sorted({" ".join(rng.choices(["ab", "a", "b", "abc", "cd", "c d"], k=rng.randint(1, 5))) for _ in range(90)})
    long = [" ".join(f"w{i}" for i in range(k, k + n)) for k, n in ((0, 11), (0, 12), (0, 13), (3, 14), (6, 12), (0, 26))]
    names = list(enumerate([*made, *long], 1))
    asked = [*made[::3], *long, "w5 w6 w7 w8 w9 w10 w11 w12 w13"]
    queries = spark.createDataFrame([(a,) for a in asked], "query string")
    index = resolve.name_index(spark.createDataFrame(names, "show_id int, name string"))
    found = resolve.search_candidates(queries, index, similarity=similarity).collect()
    got = {(r.query_key, r.name_key): (r.score, r.show_id, r.n_shows) for r in found}
    assert len(got) == len(found)
    assert got == brute_force(asked, names, similarity)
    leading = resolve.search_candidates(queries, index, similarity=similarity, leading=True).collect()
    first = {(r.query_key, r.name_key): (r.score, r.show_id, r.n_shows) for r in leading}
    assert len(first) == len(leading) and first.items() <= got.items()
    best = lambda pairs: {q: min((-s, i, n) for (p, n), (s, i, _) in pairs.items() if p == q) for q, _ in pairs}
    assert best(first) == best(got)


def test_best_of_a_small_vocabulary_makes_no_square(spark):
    """One name for each query, without a pair for every two names that share two of three words."""
    names = [(i, f"Night Harbor {i:04d}") for i in range(1000, 1400)]
    asked = [*(n[:-1] for _, n in names), *(n for _, n in names), "night harbor", "harbor 1377 night", "night 1024 lamp"]
    queries, index, found = search(spark, asked, names)
    leading = resolve.search_candidates(queries, index, leading=True)
    assert sorted(resolve.top_candidate(leading).collect()) == sorted(resolve.top_candidate(found).collect())
    assert found.count() > 150_000 and leading.count() < 1_500


def test_threshold_reaches_the_cascade(spark):
    """What people type resolves by default; a stricter threshold leaves it unresolved."""
    names = [(1, "The Office Us Archive"), (2, "Agents Of Something Else")]
    index = resolve.name_index(spark.createDataFrame(names, "show_id int, name string"))
    keys = spark.createDataFrame([("office archive",), ("the ofice us archve",)], "series_key string")
    ids = spark.createDataFrame([], "series_key string, series_id int")
    cascade = lambda **kw: {r.series_key: r.series_id for r in resolve.resolve_series(keys, ids, index, **kw).collect()}
    assert cascade()["office archive"] == 1
    assert cascade(similarity=0.75) == {"office archive": 0, "the ofice us archve": 0}
    assert {r.series_id for r in resolve.resolve_best(keys, index, similarity=0.3).collect()} == {1}


def test_ranking_policy(spark):
    _, _, found = search(spark, ["night harbor"])
    by_id = {r.query_key: r.show_id for r in resolve.top_candidate(found, -F.col("show_id")).collect()}
    assert by_id == {"night harbor": max(r.show_id for r in found.collect())}


def test_frequent_word_keeps_results_whole(spark):
    """A third of all names hold one word; none of its candidates is lost."""
    names = [(i, f"Common {i:04d}x" if i % 3 == 0 else f"Other {i:04d}y") for i in range(1, 600)]
    asked = ["common", "other 0001y", "common 0003x extra", "common 0006"]
    _, _, found = search(spark, asked, names)
    got = {(r.query_key, r.name_key): (r.score, r.show_id, r.n_shows) for r in found.collect()}
    assert got == brute_force(asked, names)
    assert sum(q == "common" for q, _ in got) == 199


def test_search_makes_no_cross_join(spark):
    _, _, found = search(spark)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_numbers_counts_and_best(spark):
    queries, index, found = search(spark)
    numbered = {(r.query_key, r.number): r.name_key for r in resolve.number_candidates(found).collect()}
    assert numbered["night harbor", 1] == "night harbor"
    best = {r.query_key: r.name_key for r in resolve.top_candidate(found).collect()}
    assert best == {q: n for (q, number), n in numbered.items() if number == 1}
    outcome = {r.query_key: r.outcome for r in resolve.candidate_count(queries, found).collect()}
    assert outcome["zzz"] == "none" and outcome["night harbor"] == "ambiguous" and "" not in outcome


def test_cascade(spark):
    keys = spark.createDataFrame([("known",), ("night harbor",), ("harbor us",), ("zzz",)], "series_key string")
    ids = spark.createDataFrame([("known", 77)], "series_key string, series_id int")
    index = search(spark)[1]
    got = {r.series_key: (r.series_id, r.id_source) for r in resolve.resolve_series(keys, ids, index).collect()}
    assert got == {
        "known": (77, "known"), "night harbor": (2, "search"), "harbor us": (3, "search"), "zzz": (0, "none"),
    }


def test_choices(spark):
    """A choice beats the best result; one that is not offered leaves the series unresolved; known IDs stay."""
    keys = spark.createDataFrame([("known",), ("night harbor",), ("night",), ("harbor us",)], "series_key string")
    ids = spark.createDataFrame([("known", 77)], "series_key string, series_id int")
    queries, index, found = search(spark, ["night harbor"])
    second = {r.number: r.show_id for r in resolve.number_candidates(found).collect()}[2]
    choices = spark.createDataFrame([("night harbor", 2), ("night", 99), ("known", 1)], "series_key string, choice int")
    got = {r.series_key: (r.series_id, r.id_source) for r in resolve.resolve_series(keys, ids, index, choices=choices).collect()}
    assert got == {"known": (77, "known"), "night harbor": (second, "choice"), "night": (0, "none"), "harbor us": (3, "search")}


def test_aliases(spark):
    layers = spark.createDataFrame(
        [(1, 1, " NIGHT HARBOR us ", "Old"), (2, 1, "Night Harbor Us", "Night Harbor"), (1, 2, "Only One", "One"),
         (2, 2, "twice", "First"), (2, 3, "TWICE", "Second")],
        "layer int, line int, variant string, preferred string",
    ).withColumn("variant_key", resolve.name_key(F.col("variant")))
    table = tables.overlay(layers, "variant_key", "preferred", ["layer", "line"])
    assert {r.variant_key: r.preferred for r in table.collect()} == {
        "night harbor us": "Night Harbor", "only one": "One", "twice": "Second",
    }
    rows = spark.createDataFrame([("night harbor US",), ("Night-Harbor Us",), ("",)], "series string")
    got = {r[0]: r[1] for r in resolve.join_aliases(rows, table).select("alias_status", "series").collect()}
    assert got["TRANSFORM"] == "Night Harbor"
    off = resolve.join_aliases(rows, None).select("alias_status").distinct().collect()
    assert [r[0] for r in off] == ["NO_TRANSFORM_SECTION"]


def test_merge_keeps_known(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "series_key string, series_id int")
    new = spark.createDataFrame([("a", 9), ("c", 4), ("c", 3), ("d", 0)], "series_key string, series_id int")
    got = sorted(r[:] for r in tables.merge_series_ids(old, new).collect())
    assert got == [("a", 1), ("b", 2), ("c", 3)]


def test_pick(spark):
    shows = "query string, number bigint, show struct<id:int>"
    options = spark.createDataFrame([("q", 1, (11,)), ("q", 2, (12,)), ("r", 1, None)], shows)
    choices = spark.createDataFrame([("q", 2), ("q", 3), ("q", 0), ("r", 1)], "query string, choice int")
    got = {(r.query, r.choice): (r.series_id, r.status) for r in resolve.pick_nth(options, choices).collect()}
    assert got == {
        ("q", 2): (12, "picked"), ("q", 3): (0, "invalid_choice"), ("q", 0): (0, "invalid_choice"), ("r", 1): (0, "no_show"),
    }


def test_hot_key_of_a_shuffle_join_is_split(spark):
    """Beyond broadcast size, a key with most of the rows does not stay in one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).repartition(8).select(
            "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"),
            F.concat(F.lit("some text to carry "), "id").alias("text"),
        )
        reference = rows.select("k").distinct().withColumn("v", F.length("k"))
        joined = resolve.attach(rows, reference, {"k": F.col("k")}, ["v"])
        assert joined.filter("v is not null").count() == 60_000
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "SortMergeJoin(skew=true)" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_tables_that_grow_in_a_plan_are_not_broadcast(spark, tmp_path):
    """A small file of names makes many signatures: their size counts, not that of the file."""
    tune(spark)
    names = spark.range(6000).select(F.col("id").cast("int").alias("show_id"), F.md5(F.col("id").cast("string")).alias("name"))
    names.write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    found = resolve.search_candidates(names.withColumnRenamed("name", "query"), resolve.name_index(names))
    assert len(found.collect()) == 6000
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [_signature" in plan and "BroadcastHashJoin [_signature" not in plan


def test_small_tables_are_broadcast_once_measured(spark):
    """AQE turns the shuffle join of a table that is small indeed into a broadcast."""
    tune(spark)
    rows = spark.range(1000).select("id", F.col("id").alias("k"))
    joined = resolve.attach(rows, rows.select("k", F.col("id").alias("v")), {"k": F.col("k")}, ["v"])
    assert len(joined.collect()) == 1000
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_rows_without_key_are_spread(spark):
    rows = spark.range(20_000).select("id", F.lit(None).cast("string").alias("k"))
    reference = spark.createDataFrame([("x", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = resolve.attach(rows, reference, {"k": F.col("k")}, ["v"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 5_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_shows_are_counted_without_pairs(spark, monkeypatch):
    draw = random.Random(4)
    name = lambda: " ".join(draw.choice("a b c d e f gg hh".split()) for _ in range(draw.choice([1, 2, 3, 3, 4, 6, 10, 14])))
    names = [(n, name()) for n in range(60)]
    asked = [name() for _ in range(40)] + [n for _, n in names[:20]] + ["zz", ""]
    queries, index, _ = search(spark, asked, names)
    want = dict.fromkeys({key(a) for a in asked} - {""}, 0)
    for (q, _), (_, _, n_shows) in brute_force(asked, names).items():
        want[q] += n_shows
    counted = resolve.search_candidates(queries, index, counted=True)
    assert {r.query_key: r.n_shows for r in resolve.candidate_count(queries, counted).collect()} == want
    # Many short names that share two words: no pair of them is made.
    short = [(n, f"night harbor {n:03d}") for n in range(200)]
    queries, index, _ = search(spark, [n for _, n in short], short)
    pairs = resolve.word_pairs
    monkeypatch.setattr(resolve, "word_pairs", lambda *given: pairs(*given).filter(F.raise_error(F.lit("a pair")).cast("boolean")))
    counted = resolve.search_candidates(queries, index, counted=True)
    assert {r.n_shows for r in resolve.candidate_count(queries, counted).collect()} == {200}


def test_names_are_joined_without_signatures(spark, monkeypatch):
    """The best of a query that is a name is that name: nothing of it is looked for by signature."""
    asked, pairs = [], resolve._signature_pairs

    def seen(keys, *more):
        asked.extend(r.query_key for r in keys.collect())
        return pairs(keys, *more)

    monkeypatch.setattr(resolve, "_signature_pairs", seen)
    queries, index, _ = search(spark, ["Night Harbor", "harbo", "the"])
    asked.clear()
    best = resolve.top_candidate(resolve.search_candidates(queries, index, leading=True)).collect()
    assert {r.query_key: (r.name_key, r.show_id) for r in best} == {"night harbor": ("night harbor", 2), "the": ("the", 9), "harbo": ("harbor", 7)}
    assert asked == ["harbo"]
