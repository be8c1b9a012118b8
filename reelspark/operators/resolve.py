"""From a series name to a catalogue ID: aliases, known IDs, then search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import name_key, search_key
from reelspark.operators.ordinals import number_rows


def attach(
    rows: DataFrame, reference: DataFrame, on: dict[str, Column], keep: list[str], how: str = "left"
) -> DataFrame:
    """Join (left or inner) to a reference table that is unique on its key columns.

    ``on`` maps key columns of the reference to expressions over ``rows``. Catalyst broadcasts
    a reference it measures as small. Beyond that, a second join key does two things: rows
    whose key has a null can match nothing and are spread by a hash of their first column (an
    identifying one) instead of meeting in one task; and the reference gets a shuffle of its
    own even if it is already partitioned by its key, without which AQE would not split a
    hot key of the row side.
    """
    keys = [f"_key_{name}" for name in on]
    absent = None
    for value in on.values():
        absent = value.isNull() if absent is None else absent | value.isNull()
    # Always 0, but not to the optimizer.
    zero = lambda *values: F.pmod(F.hash(*values), F.lit(1)).cast("bigint")
    spread = F.when(absent, F.xxhash64(rows.columns[0])).otherwise(zero(*on.values()))
    asked = rows.select(
        "*", *(value.alias(key) for key, value in zip(keys, on.values())), spread.alias("_spread")
    )
    side = reference.select(
        *(F.col(name).alias(key) for key, name in zip(keys, on)), zero(*on).alias("_spread"), *keep
    )
    return asked.join(side, [*keys, "_spread"], how).select(*rows.columns, *keep)


def join_aliases(rows: DataFrame, aliases: DataFrame | None, field: str = "series") -> DataFrame:
    """Replaces a field by its preferred spelling where the alias table has one.

    Adds ``alias_status``; without a table the step only says so.
    """
    if aliases is None:
        return rows.withColumn("alias_status", F.lit("NO_TRANSFORM_SECTION"))
    joined = attach(rows, aliases, {"variant_key": name_key(F.col(field))}, ["preferred"])
    found = F.col("preferred").isNotNull()
    return joined.withColumns(
        {
            field: F.coalesce("preferred", field),
            "alias_status": F.when(found, F.lit("TRANSFORM")).otherwise(F.lit("NO_TRANSFORM_OPTION")),
        }
    ).drop("preferred")


def join_local_ids(rows: DataFrame, ids: DataFrame, field: str = "series") -> DataFrame:
    """Adds ``local_id``: the known ID of the series, null where the name is not known."""
    known = ids.withColumnRenamed("series_id", "local_id")
    return attach(rows, known, {"series_key": name_key(F.col(field))}, ["local_id"])


def _distinct_names(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """The distinct keys that are neither null nor empty.

    Tied to a count, the test stays above the grouping: pushed below it, the key, with all
    the patterns behind it, would be computed for the test and then once more.
    """
    keys = rows.groupBy(key.alias(name)).agg(F.count("*").alias("_n"))
    return keys.filter(F.when(F.col("_n") > 0, F.col(name)) != "").select(name)


def series_keys(rows: DataFrame, field: str = "series") -> DataFrame:
    """The distinct series named in the rows, as lookup keys; unnamed rows name none."""
    return _distinct_names(rows, name_key(F.col(field)), "series_key")


def query_keys(queries: DataFrame, field: str = "query") -> DataFrame:
    """The distinct queries, as search keys."""
    return _distinct_names(queries, search_key(F.col(field)), "query_key")


def unresolved_series(rows: DataFrame, ids: DataFrame, field: str = "series") -> DataFrame:
    """Distinct series that the known IDs lack: all that has to be searched for."""
    return series_keys(rows, field).join(ids, "series_key", "left_anti")


# Search -------------------------------------------------------------------------------
#
# The index holds one entry per distinct name. A candidate is a name that equals the query,
# differs from it by one typed character, by blanks only, or by one word more or fewer, or that
# shares enough of its words. Each name stands for a number of signatures linear in its
# length, and equal signatures meet in an equi-join:
#   e  the name                                     equal names
#   i  / x  the name / all names one character shorter    one character more or fewer
#   s  the name with one character blotted out      one character replaced
#   w  / v  the name / all names one word shorter         one word more or fewer (thresholds over 0.5)
#   b  the name without blanks                      blanks only
# Words in common: see word_pairs. No name is compared with all others and no candidate is cut off.

# Share of all words of two names (Jaccard) from which they are candidates.
SIMILARITY = 0.5

# Names of up to so many words meet on two words at once; longer ones have rare words enough to meet on one.
PAIRED = 12

# Names of up to so many distinct words are counted by the sets of words they hold (255 sets at most) instead of in pairs.
COUNTED = 8


def name_index(shows: DataFrame) -> DataFrame:
    """One row per distinct search name: its lowest show ID and how many shows bear it."""
    return (
        shows.select(search_key(F.col("name")).alias("name_key"), "show_id")
        .filter(F.col("name_key") != "")
        .groupBy("name_key")
        .agg(F.min("show_id").alias("show_id"), F.count("*").alias("n_shows"))
    )


def _tagged(tag: str, text: Column) -> Column:
    return F.concat(F.lit(tag), text)


def _signatures(name: str, query_side: bool, similarity: float) -> Column:
    """All signatures of a name. The two sides swap the roles of whole and shortened names.

    Names one word apart have half of their words in common at least, so up to that threshold
    they meet by their words and need no signature.
    """
    text, words = F.col(name), F.split(F.col(name), " ")
    whole_char, short_char = ("i", "x") if query_side else ("x", "i")
    whole_word, short_word = ("v", "w") if query_side else ("w", "v")
    places = F.sequence(F.lit(1), F.length(text))
    before = lambda i: F.substring(text, F.lit(1), i - 1)
    after = lambda i: F.substring(text, i + 1, F.length(text))
    shorter = F.transform(places, lambda i: _tagged(short_char, F.concat(before(i), after(i))))
    blotted = F.transform(places, lambda i: _tagged("s", F.concat(before(i), F.lit("\0"), after(i))))
    joined = F.replace(text, F.lit(" "), F.lit(""))
    whole = [_tagged("e", text), _tagged("b", joined), _tagged(whole_char, text)]
    if similarity <= 0.5:
        return F.array_distinct(F.concat(F.array(*whole), shorter, blotted))
    fewer = F.when(
        F.size(words) > 1,
        F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: _tagged(short_word, _without(words, i))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(*whole, _tagged(whole_word, text)), shorter, blotted, fewer))


def _without(words: Column, i: Column) -> Column:
    """A name less its i-th word."""
    return F.array_join(F.concat(F.slice(words, F.lit(1), i - 1), F.slice(words, i + 1, F.size(words))), " ")


def _score(tag: Column, query: Column, name: Column) -> Column:
    """1 for equal names, else the share of words or of characters in common."""
    words = F.greatest(F.size(F.split(query, " ")), F.size(F.split(name, " ")))
    chars = F.greatest(F.length(query), F.length(name))
    return F.round(
        F.when(tag == "e", F.lit(1.0))
        .when(tag.isin("v", "w"), 1 - 1 / words)
        .otherwise(1 - 1 / chars),
        6,
    )


def _rare_first(names: DataFrame, name: str, frequency: DataFrame) -> DataFrame:
    """Adds ``_words``: the distinct words of each name, rarest first."""
    words = names.select("*", F.explode(F.array_distinct(F.split(name, " "))).alias("_word"))
    counted = attach(words, frequency, {"_word": F.col("_word")}, ["_n"])
    order = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("word"))
    return counted.groupBy(*names.columns).agg(F.sort_array(F.collect_list(order))["word"].alias("_words"))  # one name's words


def _word_keys(ordered: DataFrame, query_side: bool, similarity: float) -> DataFrame:
    """A row per key on which a name can meet another: ``_nq, _nn`` (words of query and name), ``_first, _second``.

    For two names with n and m words, the threshold names the number of common words they need. Two names
    with so many meet on ``meet`` (one or two) words among the first ``n - needed + meet`` of either. ``_at`` is the
    place of the last word of the key. Beside it, the lengths that a score needs. A column ``_least`` is a higher
    threshold of that name alone: it shortens what the name meets on, but not how many words a key has.
    """
    name, n, m = ordered.columns[0], F.size("_words"), F.col("_m")
    least = F.col("_least") if "_least" in ordered.columns else F.lit(similarity)
    sizes = F.sequence(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int"))
    common = lambda threshold: F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    needed = common(least)
    sized = ordered.withColumns({"_chars": F.length(name), "_all": F.size(F.split(name, " "))})
    sized = sized.withColumn("_m", F.explode(sizes)).withColumn("_needed", needed)
    meet = F.when((common(F.lit(similarity)) > 1) & (n <= PAIRED) & (m <= PAIRED), 2).otherwise(1)
    sized = sized.withColumn("_meet", meet).withColumn("_prefix", F.slice("_words", F.lit(1), n - F.col("_needed") + F.col("_meet")))
    sized = sized.select("*", F.posexplode("_prefix").alias("_i", "_first"))
    one = F.array(F.struct(F.col("_i").alias("at"), F.lit("").alias("word")))
    more = F.slice("_prefix", F.col("_i") + 2, F.greatest(F.size("_prefix") - F.col("_i") - 1, F.lit(0)))
    two = F.transform(more, lambda word, k: F.struct((F.col("_i") + 1 + k).alias("at"), word.alias("word")))
    keyed = sized.select("*", F.explode(F.when(F.col("_meet") == 1, one).otherwise(two)).alias("_last"))
    sides = (n, m) if query_side else (m, n)
    return keyed.select(
        *ordered.columns, "_chars", "_all", sides[0].alias("_nq"), sides[1].alias("_nn"), "_first",
        F.col("_last.word").alias("_second"), F.col("_last.at").alias("_at"), "_meet", "_needed",
    )


def word_pairs(asked: DataFrame, index: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All pairs of a query and a name, not equal, with at least that share of words in common.

    ``query_key, name_key, score, show_id, n_shows``, each pair once, with the best score of all that
    it has in common; a column ``_least`` of ``asked`` raises the threshold of single queries. A pair meets where the numbers of words allow it (length filter), on the two
    rarest words both have wherever the threshold demands two (prefix filter), and goes on if enough
    words are left behind them (positional filter); the share is then exact. Equal sets of words in another
    order, or with repeats, score below equal names.
    """
    every = index.select(F.explode(F.array_distinct(F.split("name_key", " "))).alias("_word"))
    frequency = every.groupBy("_word").agg(F.count("*").alias("_n"))
    left = _word_keys(_rare_first(asked, "query_key", frequency), True, similarity)
    right = _word_keys(_rare_first(index.select("name_key"), "name_key", frequency).join(index, "name_key"), False, similarity)
    on = ["_nq", "_nn", "_first", "_second"]
    right = right.select(
        *on, "name_key", "show_id", "n_shows", F.col("_words").alias("_others"), F.col("_at").alias("_place"),
        F.col("_chars").alias("_n_chars"), F.col("_all").alias("_n_all"),
    )
    behind = F.least(F.col("_nq") - F.col("_at"), F.col("_nn") - F.col("_place")) - 1
    common = F.col("_common")  # rarest first on both sides, so that it begins with the key a pair meets on first
    pairs = (
        left.join(right, on)
        .filter((F.col("_meet") + behind >= F.col("_needed")) & (F.col("query_key") != F.col("name_key")))
        # A generator is worked out once; a plain column would be again in every condition below.
        .withColumn("_common", F.explode(F.array(F.array_intersect("_words", "_others"))))
        .filter((F.size(common) >= F.col("_needed")) & (common[0] == F.col("_first")))
        .filter((F.col("_meet") == 1) | (F.get(common, F.lit(1)) == F.col("_second")))
    )
    q, n = F.split("query_key", " "), F.split("name_key", " ")
    words, chars = F.greatest("_all", "_n_all"), F.greatest("_chars", "_n_chars")
    share = F.size(common) / (F.col("_nq") + F.col("_nn") - F.size(common))
    # Without repeated words, names one word apart have the same score by their share.
    repeated = (F.col("_all") > F.col("_nq")) | (F.col("_n_all") > F.col("_nn"))
    fewer = lambda many, few: F.exists(F.sequence(F.lit(1), F.size(many)), lambda i: _without(many, i) == F.array_join(few, " "))
    apart = F.col("_all") - F.col("_n_all")
    by_word = F.when(repeated & (apart == 1), fewer(q, n)).when(repeated & (apart == -1), fewer(n, q)).otherwise(False)
    by_char = (F.abs(F.col("_chars") - F.col("_n_chars")) <= 1) & (F.levenshtein(F.col("query_key"), F.col("name_key"), 1) == 1)
    joined = lambda name: F.replace(F.col(name), F.lit(" "), F.lit(""))
    by_blank = (F.col("_chars") - F.col("_n_chars") == apart) & (joined("query_key") == joined("name_key"))
    score = F.greatest(
        F.least(share, 1 - 1 / (words + 1)),
        F.when(by_word, 1 - 1 / words).otherwise(0),
        F.when(by_char | by_blank, 1 - 1 / chars).otherwise(0),
    )
    rounded = F.floor(score * 1e6 + 0.5) / 1e6  # to six places, without the decimals of round()
    return pairs.select("query_key", "name_key", rounded.alias("score"), "show_id", "n_shows")


def _words_of(name: str) -> Column:
    """The distinct words of a name, in their order as text."""
    return F.sort_array(F.array_distinct(F.split(F.col(name), " ")))


def _needed(n: int, m: int, similarity: float) -> int | None:
    """How many common words names of n and m distinct words need; None where no number would do."""
    fits = lambda a, b: math.ceil(a * similarity - 1e-9) <= b <= math.floor(a / similarity + 1e-9)
    return math.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9) if fits(n, m) and fits(m, n) else None


def _word_sets(names: DataFrame, name: str, similarity: float) -> DataFrame:
    """A row per set of words, as ``_set`` of ``_held`` words, that a name of ``_n`` words can have in common with another and meet on."""
    least = [min((c for m in range(1, COUNTED + 1) if (c := _needed(n, m, similarity)) is not None), default=n + 1) for n in range(1, COUNTED + 1)]
    sized = names.withColumn("_of", _words_of(name)).withColumn("_n", F.size("_of"))
    masks = F.filter(
        F.sequence(F.lit(1), F.pow(F.lit(2), F.col("_n")).cast("int") - 1),
        lambda mask: F.bit_count(mask) >= F.element_at(F.lit(least), F.col("_n")),
    )
    held = sized.withColumn("_mask", F.explode(masks)).withColumn("_held", F.bit_count("_mask"))
    chosen = F.filter("_of", lambda _, i: F.getbit("_mask", i) == 1)
    return held.withColumn("_set", F.array_join(chosen, " ")).drop("_of", "_mask")


def word_counts(asked: DataFrame, index: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """For each query the shows of all names with at least that share of words in common, without a pair of them.

    ``query_key, n_shows``, some rows per query, to be summed; a name that equals the query counts. How many names
    hold a set of words is a count over the names alone. From the counts of a query's own sets, how many names
    hold at least c of its words follows by inclusion and exclusion: each set of j words counts
    ``(-1)^(j-c) * C(j-1, c-1)`` times, where c is the number that the threshold asks of the two numbers of words.
    So the work grows with the names, not with the pairs. Names with more than ``COUNTED`` words, of which the sets would be
    many, meet in pairs as in :func:`word_pairs`.
    """
    few = lambda name: F.size(_words_of(name)) <= COUNTED
    span = range(1, COUNTED + 1)
    factors = [
        (-1) ** (j - c) * math.comb(j - 1, c - 1) if (c := _needed(n, m, similarity)) is not None and j >= c else 0
        for n in span for m in span for j in span
    ]
    held = _word_sets(index.filter(few("name_key")).select("name_key", "n_shows"), "name_key", similarity)
    counts = held.groupBy("_set", F.col("_n").alias("_m")).agg(F.sum("n_shows").alias("_shows"))
    sets = _word_sets(asked.filter(few("query_key")).select("query_key"), "query_key", similarity)
    factor = F.element_at(F.lit(factors), ((F.col("_n") - 1) * COUNTED + F.col("_m") - 1) * COUNTED + F.col("_held"))
    counted = sets.join(counts, "_set").select("query_key", (factor * F.col("_shows")).alias("n_shows"))
    # What a long query, or a long name, can meet; equal names come with the others.
    long_names = index.filter(F.size(_words_of("name_key")) >= math.ceil((COUNTED + 1) * similarity - 1e-9))
    many = asked.filter(~few("query_key"))
    pairs = word_pairs(many, long_names, similarity).unionByName(
        word_pairs(
            asked.filter(few("query_key") & (F.size(_words_of("query_key")) >= math.ceil((COUNTED + 1) * similarity - 1e-9))),
            index.filter(~few("name_key")), similarity,
        )
    )
    equal = many.join(index.select(F.col("name_key").alias("query_key"), "n_shows"), "query_key")
    sums = counted.unionByName(pairs.select("query_key", "n_shows")).unionByName(equal.select("query_key", "n_shows"))
    return sums.groupBy("query_key").agg(F.sum("n_shows").alias("n_shows"))


def _signature_pairs(keys: DataFrame, index: DataFrame, similarity: float) -> DataFrame:
    """A row for each signature on which a query and a name meet."""
    asked = keys.withColumn("_signature", F.explode(_signatures("query_key", True, similarity)))
    offered = index.withColumn("_signature", F.explode(_signatures("name_key", False, similarity)))
    return asked.join(offered, "_signature").filter(
        # A blotted name also meets itself; equal names have their own signature.
        F.col("_signature").startswith("e") | (F.col("query_key") != F.col("name_key"))
    )


def search_candidates(
    queries: DataFrame, index: DataFrame, field: str = "query", similarity: float = SIMILARITY, leading: bool = False,
    counted: bool = False,
) -> DataFrame:
    """Candidates of each distinct query: ``query_key, name_key, score, show_id, n_shows``.

    Pairs with enough words in common come from :func:`word_pairs` with their final score; only the others
    that meet by a signature are grouped, so the many pairs of a small vocabulary are not shuffled again.
    ``leading`` leaves out candidates that another one surely beats by score, ID and name; see :func:`_leading`.
    ``counted`` gives ``query_key, n_shows`` alone, some rows per query whose sum is that over all of its candidates, and
    makes no pairs by words; see :func:`word_counts`.
    """
    keys = query_keys(queries, field)
    if leading:
        return _leading(keys, index, similarity)
    tag = F.substring("_signature", 1, 1)
    pairs = _signature_pairs(keys, index, similarity)
    q, n = F.split("query_key", " "), F.split("name_key", " ")
    share = F.size(F.array_intersect(q, n)) / F.size(F.array_union(q, n))
    apart = share < similarity - 1e-9
    near = (
        pairs.filter(apart if counted else (tag == "e") | apart)
        .groupBy("query_key", "name_key")
        .agg(
            F.max(_score(tag, F.col("query_key"), F.col("name_key"))).alias("score"),
            F.min("show_id").alias("show_id"),
            F.max("n_shows").alias("n_shows"),
        )
    )
    if counted:
        return near.select("query_key", "n_shows").unionByName(word_counts(keys, index, similarity))
    return near.unionByName(word_pairs(keys, index, similarity))


def _leading(keys: DataFrame, index: DataFrame, similarity: float) -> DataFrame:
    """Of all candidates those that can be the best of their query, each with its score.

    The best one that a query meets by a signature, of which a name has a number linear in its length, sets
    what a share of words must reach to beat or equal it. Only names with that share are looked for by their
    words, and none for a query that is a name itself, as no other score is 1. So the pairs of a
    small vocabulary, the square of the names, need not be made to find one name for each query. Queries that are
    names themselves are joined as they are, without any signature.
    """
    tag = F.substring("_signature", 1, 1)
    exact = attach(keys, index, {"name_key": F.col("query_key")}, ["show_id", "n_shows"])
    equal = exact.filter(F.col("show_id").isNotNull()).select(
        "query_key", F.col("query_key").alias("name_key"), F.lit(1.0).alias("score"), "show_id", "n_shows"
    )
    keys = exact.filter(F.col("show_id").isNull()).select("query_key")
    # All signatures: those by words too, whose score can lie above the share where a word is repeated.
    pairs = _signature_pairs(keys, index, 1.0)
    score = _score(tag, F.col("query_key"), F.col("name_key"))
    near = pairs.groupBy("query_key").agg(F.min(F.struct((-score).alias("rank"), "show_id", "name_key", "n_shows")).alias("_best"))
    near = near.select("query_key", "_best.name_key", (-F.col("_best.rank")).alias("score"), "_best.show_id", "_best.n_shows")
    reached = attach(keys, near, {"query_key": F.col("query_key")}, ["score"])
    least = F.greatest(F.lit(similarity), F.col("score") - 2e-6)  # scores are rounded to six places
    rest = reached.filter(F.coalesce("score", F.lit(0.0)) < 1).select("query_key", least.alias("_least"))
    found = near.unionByName(word_pairs(rest, index, similarity)).groupBy("query_key", "name_key").agg(
        F.max("score").alias("score"), F.min("show_id").alias("show_id"), F.max("n_shows").alias("n_shows")
    )
    return found.unionByName(equal)


def number_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``number``: the 1-based option number of each candidate, best first."""
    order = [F.col("score").desc(), F.col("show_id").asc(), F.col("name_key").asc()]
    return number_rows(candidates, order, ["query_key"], "number")


def candidate_count(queries: DataFrame, candidates: DataFrame, field: str = "query") -> DataFrame:
    """Number of shows found per query and the branch it leads to: none, unique, ambiguous.

    ``candidates`` of a search, or what it gives with ``counted``.
    """
    asked = query_keys(queries, field)
    found = candidates.groupBy("query_key").agg(F.sum("n_shows").alias("n_shows"))
    n = F.coalesce("n_shows", F.lit(0).cast("bigint"))
    return asked.join(found, "query_key", "left").select(
        "query_key",
        n.alias("n_shows"),
        F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous").alias("outcome"),
    )


def top_candidate(candidates: DataFrame, rank: Column | None = None) -> DataFrame:
    """The best candidate of each query: highest score, then lowest ID. No window, no sort of a group.

    ``rank``, over the columns of the candidates, is another policy: the lowest value wins.
    """
    policy = -F.col("score") if rank is None else rank
    best = F.min(F.struct(policy.alias("rank"), "show_id", "name_key", "score")).alias("_best")
    return candidates.groupBy("query_key").agg(best).select(
        "query_key",
        F.col("_best.show_id").alias("show_id"),
        F.col("_best.name_key").alias("name_key"),
        F.col("_best.score").alias("score"),
    )


def resolve_best(
    names: DataFrame,
    index: DataFrame,
    field: str = "series_key",
    ask: Column | None = None,
    rank: Column | None = None,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Non-interactive search: adds ``series_id``, 0 where nothing is found.

    Equal names are looked up first by a plain join; only names left over are searched by
    signature. ``ask`` may leave out names that need no search; ``rank`` is as in :func:`top_candidate`.
    """
    query = F.nullif(search_key(F.col(field)), F.lit(""))
    asked = names.withColumn("_query", query if ask is None else F.when(ask, query))
    exact = attach(
        asked, index.withColumnRenamed("show_id", "_exact"), {"name_key": F.col("_query")}, ["_exact"]
    )
    left_over = F.when(F.col("_exact").isNull(), F.col("_query"))
    rest = exact.select(left_over.alias("query"))
    candidates = search_candidates(rest, index, similarity=similarity, leading=rank is None)
    near = top_candidate(candidates, rank).withColumnRenamed("show_id", "_near")
    return attach(exact, near, {"query_key": left_over}, ["_near"]).select(
        *names.columns, F.coalesce("_exact", "_near", F.lit(0)).alias("series_id")
    )


def chosen_series(
    keys: DataFrame, index: DataFrame, choices: DataFrame, similarity: float = SIMILARITY
) -> DataFrame:
    """``series_key, series_id``: the candidate each choice names by its option number, 0 where it is not offered.

    ``choices``: series_key, choice. Only series that have a choice are searched for.
    """
    query = F.nullif(search_key(F.col("series_key")), F.lit(""))
    asked = keys.join(choices.groupBy("series_key").agg(F.max("choice").cast("bigint").alias("number")), "series_key")
    asked = asked.withColumn("query", query)
    options = number_candidates(search_candidates(asked, index, similarity=similarity)).select("query_key", "number", "show_id")
    picked = attach(asked, options, {"query_key": F.col("query"), "number": F.col("number")}, ["show_id"])
    return picked.select("series_key", F.coalesce("show_id", F.lit(0)).alias("series_id"))


def resolve_series(
    keys: DataFrame,
    ids: DataFrame,
    index: DataFrame,
    rank: Column | None = None,
    choices: DataFrame | None = None,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The cascade over distinct series: known ID, else the choice made, else best search result, else 0.

    Returns ``series_key, series_id, id_source`` (known, choice, search, none). A choice that is
    not offered leaves its series unresolved. ``rank`` is as in :func:`top_candidate`.
    """
    known = ids.withColumnRenamed("series_id", "_known")
    local = attach(keys, known, {"series_key": F.col("series_key")}, ["_known"])
    if choices is not None:
        open_keys = local.filter(F.col("_known").isNull()).select("series_key")
        chosen = chosen_series(open_keys, index, choices, similarity).withColumnRenamed("series_id", "_chosen")
        local = attach(local, chosen, {"series_key": F.col("series_key")}, ["_chosen"])
    else:
        local = local.withColumn("_chosen", F.lit(None).cast("int"))
    unknown = F.col("_known").isNull() & F.col("_chosen").isNull()
    series_id = F.coalesce("_known", "_chosen", "series_id")
    return resolve_best(local, index, ask=unknown, rank=rank, similarity=similarity).select(
        "series_key",
        series_id.alias("series_id"),
        F.when(F.col("_known").isNotNull(), "known").when(series_id == 0, "none")
        .when(F.col("_chosen").isNotNull(), "choice").otherwise("search").alias("id_source"),
    )


def pick_nth(options: DataFrame, choices: DataFrame) -> DataFrame:
    """The option a choice names, by number.

    A number that is not offered is ``invalid_choice``; an option without a show is ``no_show``.
    ``options``: query, number, show; ``choices``: query, choice.
    """
    offered = options.select(
        "query", F.col("number").alias("choice"), F.col("show.id").alias("show_id"), F.lit(True).alias("_hit")
    )
    picked = choices.withColumn("choice", F.col("choice").cast("bigint")).join(
        offered, ["query", "choice"], "left"
    )
    return picked.select(
        "query", "choice",
        F.coalesce("show_id", F.lit(0)).alias("series_id"),
        F.when(F.col("_hit").isNull(), "invalid_choice")
        .when(F.col("show_id").isNull(), "no_show")
        .otherwise("picked")
        .alias("status"),
    )
