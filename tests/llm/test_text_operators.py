"""Operators on single texts and windows: decontamination, personal data, repetition, repeated bytes, SimHash."""

import random

import numpy as np
import pytest
from tests.llm import brute
from tests.llm.conftest import SCHEMA, awkward_rows, prose

from reelspark.llm import decontaminate, repeats, simhash
from reelspark.llm.decontaminate import clean_docs, contamination
from reelspark.llm.graph import components
from reelspark.llm.pii import Limits as PiiLimits
from reelspark.llm.pii import mask_docs, personal_data, read_spans
from reelspark.llm.repeats import remove_repeats
from reelspark.llm.repetition import good_docs, repetition
from reelspark.llm.simhash import near_dedup, simhash_groups

PAIRS = [(r[0], r[1]) for r in awkward_rows()]


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_simhash_matches_all_pairs(spark, awkward):
    base = prose(20, 120).split()
    docs = list(dict(PAIRS).items())
    for i in range(40):  # near copies of one text, a word apart
        words = list(base)
        words[i * 3] = f"w{i}"
        docs.append((200 + i, " ".join(words)))
    prints = {d: brute.fingerprint(t) for d, t in docs}
    expected = brute.groups(prints)
    got = simhash_groups(awkward.select("doc_id", "text").union(spark.createDataFrame(docs[-40:], "doc_id long, text string")))
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got.collect()} == {
        (d, prints[d], expected[d]) for d in prints
    }
    assert got.count() == len(docs) + 1  # the repeated row


@pytest.mark.parametrize("cell", [4, 1024])
def test_cells_of_any_size_link_the_same(spark, cell):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 64, 12, np.uint64)
    prints = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(25):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            prints.add(int(s) ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    expected = brute.groups(dict(enumerate(prints)))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = {r.node: r.root for r in components(simhash.near_links(df, cell=cell)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    got = {}
    for i, s in enumerate(signed):
        got.setdefault(found.get(s, s), []).append(i)
    want = {}
    for i, r in expected.items():
        want.setdefault(r, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 64, (2, 2000), np.uint64)
    segments = lambda x: np.array([[(int(v) >> (2 * s) & 3).bit_count() for s in range(32)] for v in x])
    exact = np.abs(segments(a) - segments(b)).sum(1)
    assert (simhash.manhattan(simhash.popcounts(a), simhash.popcounts(b)) == exact).all()
    assert (exact <= np.bitwise_count(a ^ b)).all()


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (None, 5), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


def test_near_dedup_keeps_one_of_each_group(awkward):
    kept = near_dedup(awkward)
    assert kept.columns == awkward.columns
    expected = brute.groups({d: brute.fingerprint(t) for d, t in PAIRS})
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_contamination_matches_brute_force(spark, awkward, monkeypatch, by_shuffle):
    if by_shuffle:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    texts = dict(PAIRS)
    items = [
        (1, " ".join(texts[9].split()[100:130])), (2, "Two, WORDS!"), (3, None), (4, ""), (5, prose(90, 40)), (1, texts[5]),
        (10, " ".join(texts[9].split()[110:125])), (None, " ".join(texts[7].split()[:12])), (6, "ÜNÏCÖDÉ É"), (7, "Ünïcödé é ünïcödé"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.contamination(PAIRS, [x for x in items if x[0] is not None])
    got = rows(contamination(awkward, benchmark))
    assert [r for r in got if r[0] != 7] == sorted(r for r in expected if r[0] != 7)
    hit = next(r for r in got if r[0] == 7)  # by a window without an item
    assert hit[2] == 12 and hit[3] == 0 and hit[5]
    clean = clean_docs(awkward, benchmark)
    assert clean.columns == awkward.columns
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == [r[0] for r in got if not r[5]]


def test_contamination_of_nothing(spark, empty, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty, none).count() == 0
    assert all(not r.contaminated and r.items_sha256 == brute.sha256("") for r in contamination(awkward, none).collect())


TRICKY = [
    "a@b.c-_x@d.e a@b a@b. x@y..z q@w-e.r.t", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.002.003.004 0000255.0.0.0 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 411111111111111111111111 5 4111111111111111-",
    "+1 (947) 555-7668 +12 +1.2.3.4.5.6.7.8.9.0 ++49 30 1234567-", "é" * 50 + " a@b.cd é+49 1234567890x",
    "x" * 20000, "9" * 20000, "a.b" * 9000 + "@x.y", "1.2" * 5000, "+1" * 5000, "12 34 56 78 90 12 34 56 78 90", None, "",
]


def test_base_spans_match_brute_force(spark, awkward):
    docs = list(enumerate(TRICKY))
    got = rows(personal_data(spark.createDataFrame(docs, "doc_id long, text string")), *(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    assert got == sorted(brute.personal_data(docs))
    got = rows(personal_data(awkward), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == sorted(brute.personal_data(PAIRS))


def test_contexts_discover_unseen_identifiers(spark):
    docs = [(i, f"{prose(i, 8)} write to user{i}@mail.example.org for help {prose(i + 50, 8)}") for i in range(8)]
    docs.append((8, f"{prose(70, 8)} write to user4411#mail-example for help {prose(71, 8)}"))
    docs.append((9, f"{prose(72, 20)} order 44112233 came {prose(73, 8)}"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in personal_data(table).collect()}
    at = docs[8][1].index("user4411")
    assert spans[8] == f"email:{at}:{at + len('user4411#mail-example')}"
    assert spans[9] == "" and spans[0].count("email") == 1
    strict = {r.doc_id: r.spans for r in personal_data(table, PiiLimits(support=100)).collect()}
    assert strict[8] == "" and strict[0] == spans[0]
    masked = {r.doc_id: r.text for r in mask_docs(table).collect()}
    assert "write to [EMAIL] for help" in masked[8] and masked[9] == docs[9][1]


def test_discovery_meets_tokens_with_few_digits_before_the_at_sign(spark):
    docs = [(i, f"{prose(i, 8)} write to user{i}@mail.example.org for help {prose(i + 50, 8)}") for i in range(20)]
    found = ["anna@intranet", "anna8@intranet", "anna84@intranet", "a1b2c3@intranet", "anna84@m\u00fcller.de", "8anna@intranet"]
    docs += [(30 + i, f"{prose(70 + i, 8)} write to {t} for help {prose(90 + i, 8)}") for i, t in enumerate(found)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in personal_data(table).collect()}
    for i, t in enumerate(found):
        at = docs[20 + i][1].index(t)
        assert spans[30 + i] == f"email:{at}:{at + len(t)}"
    masked = {r.doc_id: r.text for r in mask_docs(table).collect()}
    assert all("write to [EMAIL] for help" in masked[30 + i] for i in range(len(found)))


def test_a_text_full_of_numbers_takes_no_square(spark):
    """Spans, candidates beside spans, and masking of one text with many matches; four times as many take less than eight times as long."""
    import time

    def text(n):
        tokens = (f"u{i}@a.example.org {10000 + i} 10.0.{i % 256}.{i % 251}" if i % 2 else f"{20000 + i}" for i in range(n))
        return " ".join(tokens)

    took = []
    for n in (1000, 1000, 4000):  # the first is a warm-up
        docs = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        start = time.perf_counter()
        (read,) = read_spans(docs).collect()
        took.append(time.perf_counter() - start)
        assert len(read.base) == n and len(read.seen) == 2 * n
    assert took[2] < 8 * took[1]
    (found,) = personal_data(docs).collect()
    assert (found.n_email, found.n_ip) == (n // 2, n // 2)
    assert [r[5] for r in brute.personal_data([(1, text(n))])] == [found.base_sha256]
    expected = " ".join(f"[EMAIL] {10000 + i} [IP]" if i % 2 else f"{20000 + i}" for i in range(n))
    assert mask_docs(docs).first().text == expected


def test_masking_beside_any_column_name(spark):
    docs = spark.createDataFrame([(1, "to a@b.example now", "x", "y")], "doc_id long, text string, __spans string, __doc_id string")
    assert mask_docs(docs).first().text == "to [EMAIL] now"


def test_masking_changes_spans_only(spark, awkward):
    masked = mask_docs(awkward)
    assert masked.columns == awkward.columns and masked.count() == len(PAIRS)
    texts = {r.doc_id: (r.text, r.n_chars) for r in masked.select("doc_id", "text", "n_chars").collect()}
    for doc_id, text in PAIRS:
        if doc_id == 13:
            assert texts[13][0].endswith(" [EMAIL] [IP]") and texts[13][1] == len(texts[13][0])
        else:
            assert texts[doc_id][0] == text
    overlap = spark.createDataFrame([(1, "x +1.2.3.4.5.6.7.8.9 y")], "doc_id long, text string")
    assert mask_docs(overlap).first().text == "x [PHONE] y"


def test_repetition_counts_match_brute_force(spark, awkward, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    small = [p for p in PAIRS if p[0] not in (9, 10)] + [(300, "a b c a b c # $ " * 20), (301, prose(1, 60) + " |" * 10 + "\n\n \n" + prose(1, 60))]
    df = spark.createDataFrame(small, "doc_id long, text string")
    assert rows(repetition(df), *names) == sorted(brute.repetition(small))
    assert repetition(empty).count() == 0
    verdicts = {r.doc_id: (r.base_failed, r.kept) for r in repetition(awkward).collect()}
    assert verdicts[9] == (False, True) and verdicts[0] == (True, False)
    kept = good_docs(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, _ in PAIRS if verdicts[d][1])


def test_repetition_rejects_what_the_base_rule_lets_pass(spark):
    passage = prose(30, 24)
    text = " ".join([passage, prose(31, 14), passage, prose(32, 13)])  # two copies of a passage: 48 of 75 words
    noisy = " ".join(w if i % 3 else w + str(i) for i, w in enumerate(text.split()))
    df = spark.createDataFrame([(1, "\n".join([prose(33, 30), prose(34, 30)])), (2, noisy)], "doc_id long, text string")
    assert all(r.kept for r in repetition(df).collect())
    lines = "\n".join([prose(40, 2)] * 14 + [f"{prose(50 + i, 2)}" for i in range(14)])
    got = repetition(spark.createDataFrame([(1, lines)], "doc_id long, text string")).first()
    assert not got.kept


def test_repetition_rejects_a_fifth_to_two_fifths_of_normal_lines(spark):
    docs = []
    for i, (copies, words, others) in enumerate([(2, 30, 70), (3, 12, 64), (4, 12, 62), (5, 12, 65), (4, 30, 130)]):
        line, rest = prose(60 + i, words), prose(80 + i, others).split()
        parts = [" ".join(rest[k :: copies]) for k in range(copies)]
        docs.append((i, "\n".join(x for part in parts for x in (part, line))))
        assert 0.2 < (copies - 1) * words / (copies * words + others) < 0.4
    clean = prose(90, 9)
    docs += [(10, "\n".join([clean, prose(91, 56), clean])), (11, "\n".join([clean, prose(92, 600), clean]))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (False, False) for i in range(5)} | {10: (False, True), 11: (False, True)}


def test_repeats_match_brute_force(spark, empty):
    rng = random.Random(1)
    base = "".join(rng.choice("ab c") for _ in range(3000))
    make = (
        lambda: None, lambda: "", lambda: base[rng.randint(0, 2500) :][: rng.randint(0, 900)],
        lambda: "ab" * rng.randint(0, 200), lambda: "é" * rng.randint(0, 120) + base[:300], lambda: base[:99], lambda: base[500:600],
    )
    docs = [(i, rng.choice(make)()) for i in range(80)] + list(dict(PAIRS).items())[5:10]
    docs = list(dict(reversed(docs)).items())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(remove_repeats(df)) == sorted(brute.repeats(docs))
    assert remove_repeats(empty).count() == 0


def test_repeats_in_long_texts_and_repeated_rows(spark, awkward, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 4000)
    text = prose(60, 1500)
    docs = [(1, text + " " + text[3000:5000]), (2, text[100:6000] + "!"), (3, prose(61, 2000))]
    data = list(docs)
    got = []
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in data], "text": [t for _, t in data]})
    got = pa.Table.from_batches(list(repeats._reaches(iter([batch]))))
    windows = sum(n + 1 for n in got.column("shape").to_pylist() if n >= 0)
    gone = sum(-n for n in got.column("shape").to_pylist() if n < 0)
    assert windows + gone >= sum(len(t) - 99 for _, t in data) * 0.9
    monkeypatch.undo()
    result = {r.doc_id: r for r in remove_repeats(awkward).collect()}
    assert remove_repeats(awkward).count() == len(PAIRS)
    assert result[100].n_removed == 0  # a repeated row is the same document
    assert result[6].n_removed == result[6].n_bytes and result[5].n_removed == 0


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, prose(1, 60)), (1, prose(1, 60)), (2, None)], SCHEMA.split(", lang")[0])
    assert [r.doc_id for r in simhash_groups(df).orderBy("doc_id").collect()] == [1, 2]
    assert sorted(r.doc_id for r in remove_repeats(df).collect()) == [1, 2]
    assert sorted(r.doc_id or 0 for r in personal_data(df).collect()) == [0, 1, 2]
    assert sorted(r.doc_id or 0 for r in repetition(df).collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in good_docs(df).collect()) == [1]
