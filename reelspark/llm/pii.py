"""Personal data: fixed patterns, then identifiers found through the company they keep. DataFrame only.

Base spans come from four regular expressions. They are the seeds of a graph: an instance (a kind and a
value) is linked to the lexical patterns it stands in (the words beside it). Candidates are other
identifier-like tokens and stand in the same graph. Each round gives every pattern the mean confidence
of its instances, and every candidate the noisy-or of its trusted patterns; candidates that end over the
limit become spans of the kind of their patterns.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that the engine never tries a place twice. A match can only
#: begin where a run of its first characters begins, or right behind the last match; loops are possessive
#: where nothing they could give back would help. Cards: a maximal run of 13 to 19 digits.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text has to pass before a pattern is tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Tokens that may be identifiers: with an at sign, or with four digits.
CANDIDATE = r"(?<!\S)(?:[^\s@]*+@|[^\s0-9]*+(?:[0-9][^\s0-9]*+){4})\S*+"
CONTEXT = 60


@dataclass(frozen=True)
class Limits:
    """rounds of scoring; distinct seeds a pattern needs; confidence a pattern and a discovery need."""

    rounds: int = 3
    support: int = 3
    pattern: float = 0.6
    discovery: float = 0.8


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) <= 3) & (part(x).try_cast("int") <= 255))
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, combine) -> Column:
    """Running results of an associative operation over an array, by doubling: as many rounds as its length has bits."""

    def step(held: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(held, lambda v, i: F.when(i >= back, combine(v, F.get(held, i - back))).otherwise(v))

    rounds = lambda v: F.sequence(F.lit(0), F.length(F.bin(F.size(v).cast("bigint"))) - 1)
    return _let(values, lambda v: F.aggregate(rounds(v), v, step))


def _spans(text: Column, pattern: str, hint: str, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of all matches, in order; positions in code points."""
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )

    def read(p: Column) -> Column:
        steps = F.transform(p["found"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m))
        span = lambda m, end: F.struct(
            F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")
        )
        return _let(
            _scan(steps, lambda a, b: a + b), lambda ends: F.transform(p["found"], lambda m, i: span(m, F.get(ends, i)))
        )

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(text.rlike(hint), _let(parts, read)).otherwise(none)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that touch none of the others, by start.

    All are put in order; a span is apart if the greatest end of the others before it is not behind
    its start, and the least start of those after it not before its end.
    """
    entry = lambda own: lambda s: F.struct(
        s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")
    )
    merged = F.array_sort(F.concat(F.transform(spans, entry(True)), F.transform(others, entry(False))))

    def free(m: Column) -> Column:
        ends = F.transform(m, lambda x: F.when(x["own"], -1).otherwise(x["end"]))
        starts = F.reverse(F.transform(m, lambda x: F.when(x["own"], (1 << 31) - 1).otherwise(x["start"])))
        bounds = F.struct(
            _scan(ends, lambda a, b: F.greatest(a, b)).alias("before"),
            F.reverse(_scan(starts, lambda a, b: F.least(a, b))).alias("after"),
        )
        kept = lambda b: lambda x, i: x["own"] & (F.get(b["before"], i) <= x["start"]) & (F.get(b["after"], i) >= x["end"])
        return F.transform(_let(bounds, lambda b: F.filter(m, kept(b))), lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "value"))))

    return F.when(F.size(others) == 0, spans).otherwise(_let(merged, free))


def base_spans(text: Column) -> Column:
    """Valid spans of the four kinds, by kind as listed, then by start."""
    valid = lambda kind: F.filter(_spans(text, BASE[kind], HINT[kind], kind), lambda s: _valid(kind, s["value"]))
    return F.concat(*map(valid, KINDS))


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _contexts(text: Column, span: Column) -> Column:
    """The lexical patterns of a span: words on both sides, two to the left, two to the right."""
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT))))
    after = F.lower(F.substring(text, span["end"] + 1, F.lit(CONTEXT)))
    left, right = F.regexp_extract(before, r"(\S+)\s+$", 1), F.regexp_extract(after, r"^\s+(\S+)", 1)
    lefts, rights = F.regexp_extract(before, r"(\S+\s+\S+)\s+$", 1), F.regexp_extract(after, r"^\s+(\S+\s+\S+)(?=\s|$)", 1)
    either = F.array(
        F.when((left != "") & (right != ""), F.concat(F.lit("lr "), left, F.lit(" "), right)),
        F.when(lefts != "", F.concat(F.lit("ll "), lefts)),
        F.when(rights != "", F.concat(F.lit("rr "), rights)),
    )
    return F.filter(either, lambda x: x.isNotNull())


def read_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans), open (candidate spans that touch no base span, and their patterns, and those of base spans)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", base_spans(F.col("text")).alias("found"))
    rows = rows.withColumn("open", _let(_spans(F.col("text"), CANDIDATE, "[0-9@]", ""), lambda c: _apart(c, F.col("found"))))
    seen = F.transform(
        F.concat("found", "open"),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _contexts(F.col("text"), s).alias("patterns")),
    )
    return rows.select("doc_id", F.transform("found", lambda s: s.dropFields("value")).alias("base"), seen.alias("seen"))


def discovered(read: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(kind, value) of the candidates that the graph of patterns and instances trusts."""
    limits = limits or Limits()
    edges = (
        read.select(F.explode("seen").alias("s"))
        .select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
        .distinct()
    )
    seeds = edges.where("kind <> ''").groupBy("pattern", "kind").agg(F.count_distinct("value").alias("n"))
    useful = seeds.where(F.col("n") >= limits.support)
    # each pattern once for every kind that seeds it; an instance counts there with its own confidence
    graph = written(
        edges.withColumnRenamed("kind", "own")
        .join(useful.select("pattern", "kind"), "pattern")
        .select("kind", "pattern", "value", (F.col("own") == F.col("kind")).alias("seed"), (F.col("own") == "").alias("open")),
        "graph",
    )
    trust = graph.select("kind", "value").distinct().withColumn("trust", F.lit(0.0))
    for _ in range(limits.rounds):
        scored = graph.join(trust, ["kind", "value"]).withColumn("c", F.when(F.col("seed"), 1.0).otherwise(F.col("trust")))
        strength = scored.groupBy("kind", "pattern").agg(F.avg("c").alias("strength")).where(F.col("strength") >= limits.pattern)
        doubt = F.sum(F.log1p(-F.least("strength", F.lit(0.99))))
        voted = graph.where("open").join(strength, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("voted"))
        trust = written(
            trust.join(voted, ["kind", "value"], "left").select("kind", "value", F.coalesce("voted", "trust").alias("trust")), "trust"
        )
    best = trust.where(F.col("trust") >= limits.discovery).groupBy("value").agg(F.max(F.struct("trust", "kind"))["kind"].alias("kind"))
    return best.select("kind", "value")


def all_spans(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, base, added: the base spans and the discovered ones of each row, without the text."""
    read = written(read_spans(docs), "spans")
    found = written(discovered(read, limits), "discovered")
    added = (
        read.select("doc_id", F.explode("seen").alias("s"))
        .where("s.kind = ''")
        .select("doc_id", "s.start", "s.end", "s.value")
        .join(found, "value")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    )
    return read.join(added, "doc_id", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added")
    )


def _ordered(spans: Column) -> Column:
    """By kind as listed, then by start."""
    of_kind = lambda kind: F.array_sort(F.filter(spans, lambda s: s["kind"] == kind))
    return F.concat(*map(of_kind, KINDS))


def personal_data(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs.

    The counts and the digest are of the base spans; spans also lists discovered ones, in the same order.
    A null text is empty. Repeated rows give a row each; a row without doc_id keeps its base spans
    and gets no discovered ones.
    """
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return all_spans(docs, limits).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(_ordered(F.concat("base", "added"))).alias("spans"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(o: Column, reach: Column) -> Column:
        piece = lambda s, at: F.when(
            s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        ).otherwise("")
        pieces = F.transform(o, lambda s, i: piece(s, F.coalesce(F.get(reach, i - 1), F.lit(0))))
        rest = F.substring(text, F.element_at(reach, -1) + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), rest)

    ends = lambda o: _scan(F.transform(o, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return _let(ordered, lambda o: _let(ends(o), lambda reach: cut(o, reach)))


def mask_docs(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """docs with all spans replaced by [EMAIL], [IP], [CARD] or [PHONE]; n_chars, where there is one, follows.

    Texts without spans, nulls included, stay as they are.
    """
    read, name = all_spans(docs, limits), f"_{uuid4().hex}"  # no column of docs is called so
    spans = written(
        read.where("doc_id is not null and size(base) + size(added) > 0")
        .groupBy("doc_id")
        .agg(F.first(F.concat("base", "added")).alias(name)),
        "mask",
    ).withColumnRenamed("doc_id", f"{name}id")
    text = F.when(F.col(name).isNotNull(), _masked(F.col("text"), F.col(name))).otherwise(F.col("text"))
    out = docs.join(spans, docs["doc_id"].cast("long") == spans[f"{name}id"], "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(name).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(*docs.columns)
