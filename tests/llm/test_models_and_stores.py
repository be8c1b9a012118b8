"""Models on held-out folds, packing, archives and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm import brute
from tests.llm.conftest import awkward_rows, prose

import corpus_pipeline
from reelspark.llm.calibration import calibrated, isotonic
from reelspark.llm.language import grams, language
from reelspark.llm.packing import cuts, pack, plan, token_ids
from reelspark.llm.quality import STATISTICS, quality, statistics
from reelspark.llm.toxicity import Matcher, lexicon, toxicity
from reelspark.llm.warc import END, export_warc, page_records, read_archive, write_archive

SF = "/root/testdata/sf0.01"
PAIRS = [(r[0], r[1]) for r in awkward_rows()]


def fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def given(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages")}


def marks(given, column):
    return {r.doc_id: r[column] for r in given["labels"].collect()}


def accuracy(rows, truth):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality_on_held_out_rows(given):
    got = quality(given["documents"], given["labels"]).collect()
    assert len(got) == given["documents"].count()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert accuracy(got, marks(given, "quality")) > 0.95


def test_squeeze_is_of_the_whole_text():
    squeeze = STATISTICS.index("squeeze")
    text = prose(1, 300_000)
    head = text[: 1 << 20]
    assert len(text) > 1 << 20
    for whole in (head + "junk line\n" * 300_000, text, head[:5000]):
        assert statistics(whole)[squeeze] == len(zlib.compress(whole.encode(), 1)) / len(whole)
    assert statistics(head + "junk line\n" * 300_000)[squeeze] < 0.5 * statistics(head)[squeeze]


def test_toxicity_on_held_out_rows(given):
    got = toxicity(given["documents"], given["labels"]).collect()
    assert len(got) == given["documents"].count()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert accuracy(got, marks(given, "toxic")) > 0.9
    clean = [r for r in got if marks(given, "toxic").get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_language_on_held_out_rows(given):
    truth = {r.doc_id: r.lang for r in given["documents"].select("doc_id", "lang").collect()}
    got = language(given["documents"]).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_models_on_awkward_tables(spark, awkward, empty, given):
    labels = given["labels"].limit(0)
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 1), (None, 1, 1), (5, 1, 1), (6, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for model in (quality, toxicity):
        assert model(empty, labels).count() == 0
        for known in (labels, some):
            got = model(awkward, known).collect()
            assert len(got) == len(PAIRS) and all(0 <= r.score <= 1 for r in got)
    assert language(empty).count() == 0
    got = {r.doc_id: r for r in language(awkward).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[9].lang_pred == "en"
    nothing = language(awkward.where("lang is null")).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in nothing)


def test_grams_are_counted_exactly():
    keys, counts = grams("Ab-ab É")
    found = {tuple(int(k) >> s & 0x1FFFFF for s in (42, 21, 0) if int(k) >> s): int(n) for k, n in zip(keys, counts)}
    a, b, e, edge = ord("a"), ord("b"), ord("é"), 1
    expected = Counter([(a,), (b,), (a,), (b,), (e,)])
    line = [edge, a, b, edge, a, b, edge, e, edge]
    expected.update(zip(line, line[1:]))
    expected.update(zip(line, line[1:], line[2:]))
    assert found == dict(expected)
    assert len(grams("12 - 34")[0]) == 0 and len(grams(None)[0]) == 0


def edits(a: str, b: str) -> int:
    """Edits with swapped neighbours as one."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_agrees_with_the_edit_table():
    rng = random.Random(2)
    lexicon = ["".join(rng.choices("abcd", k=rng.randint(5, 11))) for _ in range(30)]
    matcher = Matcher(lexicon)
    for _ in range(3000):
        token = list(rng.choice(lexicon))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(token))
            change = rng.choice(["drop", "swap", "put", "add"])
            if change == "drop" and len(token) > 1:
                token.pop(i)
            elif change == "swap" and i:
                token[i - 1], token[i] = token[i], token[i - 1]
            elif change == "put":
                token[i] = rng.choice("abcd")
            else:
                token.insert(i, rng.choice("abcd"))
        word = "".join(token)
        fewest = min(edits(word, w) for w in lexicon)
        assert matcher.near(word) == (fewest <= 1)
        assert matcher.weight(word) == {0: 1.0, 1: 0.6}.get(fewest, 0.0)


def test_quotation_counts_less():
    matcher = Matcher(["nasty", "vile*"])
    assert matcher.hits('He said "nasty" there') < matcher.hits("a nasty thing") == matcher.hits("a vileword here") == 1.0
    assert 0 < matcher.hits("a nasti thing") < 1 and matcher.hits(None) == 0
    long = 'she said "you are a complete and utter %s my friend, and I told them so more than once" and left'
    for opening, closing in ('""', "“”", "„“", "«»", "»«"):
        assert matcher.hits(long.replace('"', opening, 1).replace('"', closing, 1) % "nasty") == 0.3
    straight = ['a 5" pipe, you nasty thing, and a 6" pipe', 'so "nice"\nyou nasty "thing"', '"a" nasty "b"', f'"{"far " * 90}nasty"', 'nasty "x"']
    assert [matcher.hits(t) for t in straight] == [1.0] * len(straight)
    assert matcher.hits('"nasty" nasty "so nasty" ' * 3) == pytest.approx(3 * 1.6)


def test_scores_match_plain_edit_distance(spark):
    """Every token against every term, and a curve on the sums, give the operator's scores."""
    docs, marks = [], []
    for i in range(300):
        word = ["worthless", "pathetic", "idiot"][i % 3] if i < 90 else prose(i, 1)
        docs.append((i, f"{prose(i, 15)} {word} {prose(i + 1000, 15)}"))
        marks.append((i, int(i < 90)))
    spoiled = ["wortless", "wrothles", "patetik", "pathetic", "idoit", "ideot", "idt", "worth", '"idiot"']
    docs += [(1000 + i, f"{prose(i + 5000, 9)} {w} {prose(i + 6000, 9)}") for i, w in enumerate(spoiled)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known, own = lexicon(df.join(spark.createDataFrame(marks, "doc_id long, y int"), "doc_id").where("crc32(cast(doc_id as string)) % 4 <> 2").select("text", "y"))
    words, stems = [t for t in known if t[-1] != "*"], tuple(t[:-1] for t in known if t[-1] == "*")
    def weight(token):
        if token in words or token.startswith(stems or ("\n",)):
            return 1.0
        found = [] if token in own or len(token) < 4 else [d for w in words if len(w) > 4 and (d := edits(token, w)) <= 1]
        return 0.6 if found else 0.0

    got = {r.doc_id: r for r in toxicity(df, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    sums = {d: sum(weight(w.strip('"')) * (0.3 if '"' in w else 1) for w in t.split()) for d, t in docs}
    by_sum = sorted((round(sums[d], 6), got[d].score) for d, _ in docs)
    assert {"worthless", "pathetic", "idiot"} <= set(words)
    assert len({s for s, _ in by_sum}) >= 3
    for (s, score), (t, other) in zip(by_sum, by_sum[1:]):
        assert score == pytest.approx(other) if s == t else score < other  # one rising curve over the sums
    assert [got[1000 + i].predicted for i in range(7)] == [1, 0, 0, 1, 1, 1, 0]


def test_learned_terms_are_met_misspelled(spark):
    """Stems of the learned terms are learned as well and must not take the whole words out of the trie."""
    docs, toxic = [], []
    for i in range(400):
        word = ["stupid", "disgusting", "worthless"][i % 3] if i < 120 else "oron"
        docs.append((i, f"{prose(i, 20)} {word} {prose(i + 1000, 20)}"))
        toxic.append((i, int(i < 120)))
    docs += [(i, f"{prose(i, 20)} moron {prose(i + 1000, 20)}") for i in range(400, 440)]
    toxic += [(i, 1) for i in range(400, 440)]
    spoiled = ["tsupid", "xtupid", "stpid", "dsigusting", "digusting", "wurthless", "owrthless", "mroon"]
    docs += [(1000 + i, f"{prose(i + 5000, 20)} {w} {prose(i + 6000, 20)}") for i, w in enumerate([*spoiled, "oron", "und"])]
    got = toxicity(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(toxic, "doc_id long, toxic int")
    ).where("doc_id >= 1000").collect()
    found = {r.doc_id - 1000: r.predicted for r in got}
    assert [found[i] for i in range(len(found))] == [1] * len(spoiled) + [0, 0]


def test_isotonic_is_monotone_and_pools():
    x, rate = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert np.allclose(rate, [0.0, 0.5, 1.0]) and np.allclose(x, [0.0, 1.5, 3.0])
    assert calibrated(np.array([-1.0, 0.75, 9]), (x, rate)).tolist() == [0.0, 0.25, 1.0]
    assert calibrated(np.array([1.0]), isotonic(*[np.empty(0)] * 3)).tolist() == [0.5]


def test_ids_are_those_of_the_tokenizer_file(given):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in given["documents"].select("text").collect()] + [t for _, t in PAIRS]
    for text in texts:
        assert token_ids(text).tolist() == [*full.encode(text or "", add_special_tokens=False).ids, 0]


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 4000):
        lengths = np.minimum(rng.lognormal(5.5, 1.3, n).astype(int) + 1, 2048)
        histogram = np.bincount(lengths, minlength=2049)
        used = np.zeros(2049, int)
        planned = plan(histogram)
        for shape, repeats in planned:
            assert sum(shape) <= 2048
            for length in shape:
                used[length] += repeats
        assert (used == histogram).all()
        bound = -(-int((histogram * np.arange(2049)).sum()) // 2048)
        assert sum(r for _, r in planned) <= 1.02 * bound + 1


def check_packing(rows, texts):
    """Every document whole and in order, sequences gapless and within bounds."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted({d for d, _ in texts})
    for doc_id, text in dict(texts).items():
        ids = token_ids(text)
        wanted = Counter((i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(cuts(len(ids))))
        copies = sum(d == doc_id for d, _ in texts)
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == Counter({k: copies for k in wanted})
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing(spark, awkward, empty):
    texts = [*PAIRS, *((1000 + i, prose(i, 3 + 7 * i)) for i in range(60))]
    rows = pack(awkward.select("doc_id", "text").union(spark.createDataFrame(texts[len(PAIRS) :], "doc_id long, text string"))).collect()
    check_packing(rows, texts)
    assert len({r.sequence_id for r in rows}) <= sum(r.length for r in rows) / 2048 * 1.05 + 1
    assert pack(empty).count() == 0
    assert cuts(4096) == [(0, 2048), (2048, 2048)] and cuts(2050) == [(0, 2), (2, 2048)] and cuts(1) == [(0, 1)]


def test_archive_round_trip(spark, tmp_path):
    big, same = "<p>" + "é" * 600, "x" * 1000
    pages = [
        (1, "http://a/1", same), (2, "http://a/2\r\nWARC-Type: revisit", same), (3, None, same), (4, "u", "small"), (5, "u", "small"),
        (6, "u", None), (7, "u", ""), (8, "u", big + "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n"), (9, "u", same[:-1]), (9, "u", same[:-1]), (None, "u", same),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'extra' as address", "1 as kept")
    got = page_records(df.repartition(3), str(tmp_path / "a")).collect()
    import hashlib

    size = {i: len((h or "").encode()) for i, _, h in pages}
    assert len(got) == len(pages)
    for r in got:
        html = next(h for i, _, h in pages if i == r.page_id) or ""
        assert r.payload_bytes == size[r.page_id] and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds[:4] == [(0, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None)]
    assert all(k[1:] == ("response", None) for k in kinds[4:])
    export_warc(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    records = []
    while raw:  # by Content-Length, as any reader does
        head, _, raw = raw.partition(b"\r\n\r\n")
        n = int(next(x for x in head.decode().split(END) if x.startswith("Content-Length: ")).split()[1])
        records.append((head, raw[:n]))
        assert raw[n : n + 4] == b"\r\n\r\n"
        raw = raw[n + 4 :]
    assert len(records) == len(pages)
    stored = sorted(body for head, body in records if b"WARC-Type: response" in head)
    assert stored.count(same.encode()) == 1 and (big + "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n").encode() in stored


def test_damaged_payloads_are_noticed(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    write_archive(pages, str(tmp_path / "a"))
    payloads = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.lit("other").cast("binary"))
    payloads.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="payload damaged"):
        read_archive(spark, str(tmp_path / "b")).collect()


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_records(pages, str(tmp_path / "a")).count() == 0


def test_pipeline_against_plain_stages(spark, given):
    """Each stage on its own input, by brute force, and run() as the last stage's rows."""
    docs = given["documents"].where("doc_id < 150")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in out.collect()}
        after_df = stage(spark, out, SF)
        assert after_df.columns == docs.columns, name
        after = {r.doc_id: r for r in after_df.collect()}
        pairs = [(d, r.text) for d, r in before.items()]
        if name == "quality_rules":
            failed = {r[0] for r in brute.repetition(pairs) if r[-1]}
            assert not failed & after.keys() and len(after) >= 0.97 * (len(before) - len(failed))
        elif name == "near_duplicates":
            assert after.keys() == set(brute.groups({d: brute.fingerprint(t) for d, t in pairs}).values())
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in given["benchmark"].collect()]
            assert after.keys() == {r[0] for r in brute.contamination(pairs, items) if not r[-1]}
        else:
            base = {r[0]: sum(r[1:5]) for r in brute.personal_data(pairs)}
            assert after.keys() == before.keys()
            assert all((after[d].text == before[d].text) == (base[d] == 0) for d in base)
            assert not any(sum(r[1:5]) for r in brute.personal_data([(d, r.text) for d, r in after.items()]))
        if name != "personal_data":
            assert all(after[d] == before[d] for d in after)
        out = spark.createDataFrame(list(after.values()), docs.schema)
    check_packing(corpus_pipeline.STAGES[-1][1](spark, out, SF).collect(), [(r.doc_id, r.text) for r in out.collect()])


def test_pipeline_runs_over_the_whole_table(spark, given):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in given["documents"].select("doc_id").collect()}
