"""Filter audit, packing in tiers and vector codes against brute force and exact round trips."""

import hashlib
import random
import unicodedata
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import CLASHES, awkward_rows, prose

from reelspark.llm import gnat, interactions, tiers
from reelspark.llm.gnat import Nearest, vector_codes
from reelspark.llm.interactions import filter_audit
from reelspark.llm.tiers import tier_pack

LABELS = "doc_id long, quality int, toxic int"

# Filter audit ---------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    """Every order walked for itself, document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    failed = []
    for d, text, source in docs:
        words, text = (text or "").encode().split(), text or ""
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and least[text] < d,
        }
        failed.append((source or "", {f for f, bad in fails.items() if bad}, d in good, d in toxic))
    rows = {}
    for part in {p for p, *_ in failed}:
        own = [(bad, g, t) for p, bad, g, t in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[0]]
                alive = [x for x in alive if f not in x[0]]
                failing = sum(f in bad for bad, *_ in own)
                alone = sum(bad == {f} for bad, *_ in own)
                shapley[f] += len(gone)
                rows[part, "".join(order), step] = [
                    len(alive), len(gone), failing - len(gone), alone, sum(g for _, g, _ in gone), sum(t for *_, t in gone),
                ]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return rows


def audited(df):
    found = df.collect()
    rows = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(rows) == len(found)
    return rows


def test_audit_matches_a_walk_of_every_order(spark, awkward):
    given = [(r[0], r[1], r[3]) for r in awkward_rows()]
    rng = random.Random(5)
    more = [prose(i, rng.choice([150, 220, 260])) + rng.choice(["", " #", " A B C D" * 9, " same word" * 300]) for i in range(12)]
    extra = [(500 + i, more[i % 12], rng.choice(["s", "t", None])) for i in range(40)]
    extra += [(None, more[0], "s"), (None, None, None), (499, more[1], "t")]
    labels = [(500 + i, i % 2, int(i % 7 == 0)) for i in range(30)] + [(500, 0, 1), (502, None, None), (None, 1, 1), (3, 1, None)]
    docs = awkward.select("doc_id", "text", "source", "score", "part", "words").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string, source string"), allowMissingColumns=True
    )
    marks = spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("x"))
    assert audited(filter_audit(docs, marks)) == audit_by_hand(given + extra, labels)


def test_one_text_in_most_rows(spark):
    rows = [(i, "a copy" if i % 3 else prose(i, 5), f"s{i % 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    assert audited(filter_audit(docs, spark.createDataFrame([], LABELS))) == audit_by_hand(rows, [])


def test_audit_of_nothing(spark, empty):
    assert filter_audit(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_survivors_of_every_subset():
    cells = np.random.default_rng(1).integers(0, 9, (3, 16, 2))
    states = interactions.survivors(cells)
    for subset in range(16):
        alive = [m for m in range(16) if not m & subset]
        assert (states[:, subset] == cells[:, alive].sum(1)).all()


# Packing in tiers -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: full.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s(library):
    encoder, rng = tiers.encoder("word_bpe_49k"), random.Random(2)
    alphabet = "abcDEZ'. \nΣ́é中İßKÅ1²\x1c\x85 ​\U0001f600\x00"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "x" * 9000, "͸ unassigned", *(r[1] for r in awkward_rows())]
    for low in range(0x250, 0x3000, 40):
        texts.append("a".join(chr(c) for c in range(low, low + 40)))
    for text in texts:
        assert encoder.ids(text).tolist() == library(text), ascii(text)
    assert any(not unicodedata.is_normalized("NFC", t or "") for t in texts)


def packed(df, tier=4096):
    found = df.toPandas()
    places = found.sort_values(["sequence_id", "offset"])
    sequences = places.groupby("sequence_id")
    assert (sequences["length"].cumsum() - places["length"] == places["offset"]).all()  # gapless
    total = sequences["length"].sum()
    assert (total == sequences["window"].first()).all() and (total <= tier).all()
    assert all(int(n).bit_count() == 1 for n in total)  # no padding at all
    assert sequences["step_group"].nunique().eq(1).all()
    return found


def test_every_id_lies_in_one_piece(awkward, library):
    found = packed(tier_pack(awkward))
    texts = {r[0]: r[1] for r in awkward_rows()}
    times = {d: sum(r[0] == d for r in awkward_rows()) for d in texts}
    for doc_id, pieces in found.groupby("doc_id"):
        ids = np.array([*library(texts[doc_id]), 2], "<u4")
        assert (pieces["doc_tokens"] == len(ids)).all()
        cover = np.zeros(len(ids), int)
        for p in pieces.itertuples():
            cover[p.start : p.start + p.length] += 1
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert (cover == times[doc_id]).all()
    assert set(found["doc_id"]) == set(texts)


def test_rows_without_doc_id_and_empty_tables(spark, empty):
    found = packed(tier_pack(spark.createDataFrame([(None, "one two", "x"), (None, None, "y")], "doc_id long, text string, ids string")))
    assert sorted(found["doc_tokens"].unique()) == [1, 3] and found["doc_id"].isna().all()
    assert tier_pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_up_any_histogram(seed):
    rng = np.random.default_rng(seed)
    tier = (64, 32, 16, 8)
    histogram = np.zeros(65, np.int64)
    for n in rng.integers(1, 65, rng.integers(0, 9)):
        histogram[n] += rng.choice([1, 2, 7, 1000, 10**9])
    planned = tiers.plan(histogram, tier)
    assert len(planned) < 2000  # the plan does not grow with the counts
    for window, repeats, slots in planned:
        offset = 0
        for at, stretches in slots:
            assert at == offset and sum(s[4] for s in stretches) == repeats
            (width,) = {hi - lo for _, lo, hi, _, _ in stretches}
            offset += width
        assert offset == window and window.bit_count() == 1
    assert sum(w * r for w, r, _ in planned) == (histogram * np.arange(65)).sum()
    if planned:
        to = tiers.places(planned)
        for i in range(len(to["length"])):  # the slices of a piece cover it once
            part = slice(to["at"][i], to["at"][i + 1])
            lo, hi = to["lo"][part], to["hi"][part]
            assert lo[0] == 0 and hi[-1] == to["length"][i] and (lo[1:] == hi[:-1]).all()
        assert {int(n) for n in to["length"]} == set(np.nonzero(histogram)[0].tolist())


def test_short_documents_fill_the_gaps_whole():
    histogram = np.zeros(4097, np.int64)
    histogram[[3000, 1096, 700, 324, 200]] = 5000
    planned = tiers.plan(histogram)
    cut = {s[0] for *_, slots in planned for _, st in slots for s in st if s[2] - s[1] < s[0]}
    assert cut == {200}  # nothing is left to go beside these
    assert planned[0][0] == 4096 and [st[0][0] for _, st in planned[0][2]] == [3000, 1096]


def test_step_groups_are_of_one_size(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "word " * rng.choice([3, 90, 400, 900, 2500])) for i in range(400)], "doc_id long, text string")
    found = packed(tier_pack(docs, step_tokens=1 << 15))
    tokens = found.groupby("step_group")["length"].sum()
    assert len(tokens) > 5 and tokens.max() - tokens.min() <= sum(tiers.TIERS)


# Vector codes ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, v int"


def coded_by_hand(kept, parts=16, entries=64, rounds=2):
    """Plain product quantisation: every part against every entry. ``kept``: (vec_id, vector, label)."""
    width = max(len(v) for _, v, _ in kept)
    width += -width % parts
    most = gnat.limit(width)
    v = np.array([[min(max(int(np.floor(256 * float(x))), -most), most) for x in v] + [0] * (width - len(v)) for _, v, _ in kept], object)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, v[i].tolist()))
    first, seen = [], set()
    for i in order:
        if kept[i][0] not in seen and len(first) < entries:
            seen.add(kept[i][0])
            first.append(v[i])
    books = [np.array(first, object)[:, p * width // parts : (p + 1) * width // parts] for p in range(parts)]
    pieces = [v[:, p * width // parts : (p + 1) * width // parts] for p in range(parts)]

    def nearest(x, book):
        d = [int(((x - e) ** 2).sum()) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            home = [nearest(x, books[p])[0] for x in pieces[p]]
            after = books[p].copy()
            for e in set(home):
                own = [x for x, h in zip(pieces[p], home) if h == e]
                after[e] = [int(s) // len(own) for s in sum(own)]
            books[p] = after
    found = [[nearest(x, books[p]) for x in pieces[p]] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    errors = [sum(found[p][i][1] for p in range(parts)) for i in range(len(kept))]
    of_label = {}
    for (_, _, label), e in zip(kept, errors):
        of_label[label] = of_label.get(label, 0) + e
    return sorted(
        (repr(k[0]), "".join(f"{found[p][i][0]:02x}" for p in range(parts)), errors[i], of_label[k[2]], sha) for i, k in enumerate(kept)
    )


def codes(df):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_match_plain_quantisation(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0, 0.2, 64).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(300)]
    for i in range(0, 300, 7):  # ties: few distinct values
        rows[i] = (rows[i][0], [round(x) / 2 for x in rows[i][1]], None)
    rows += [rows[0], rows[0], (None, rows[5][1], 1), (900, [0.5] * 64, None)]
    bad = [(1000, None, 1), (1001, [None] * 64, 1), (-5, [float("nan")] * 64, 1), (-6, [float("inf")] + [0.0] * 63, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], VECTORS).repartition(5)
    assert codes(vector_codes(df)) == coded_by_hand(rows)


def test_odd_vectors(spark):
    rows = [(1, [0.1] * 3, 1), (2, [], None), (3, [1e30, -1e30] * 9, 1), (4, [0.0] * 17, 1), (4, [-0.25] * 17, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    assert codes(vector_codes(df)) == coded_by_hand([(i, np.array(v, np.float32), x) for i, v, x in rows])
    assert vector_codes(df.where("false")).count() == 0


@pytest.mark.parametrize("spread", [2, 30, 10**6])
def test_tree_finds_the_lower_of_equal_entries(spread):
    rng = np.random.default_rng(spread)
    entries, queries = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (3000, 4))
    entries[40], entries[63] = entries[7], entries[0]
    find = Nearest(entries)
    index, best = find(queries)
    d2 = ((queries[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d2.argmin(1)).all() and (best == d2.min(1)).all()
    if spread > 100:
        assert find.met < 0.8 * d2.size  # whole subtrees are dropped


def test_extra_columns_do_not_matter(spark, awkward):
    marks = spark.createDataFrame([(1, 1, 0)], LABELS)
    plain = awkward.drop(*CLASHES)
    assert audited(filter_audit(awkward, marks)) == audited(filter_audit(plain, marks))
