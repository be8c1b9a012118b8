"""The plans a user runs: process, infer_report, fetch_report, apply."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import paths
from reelspark.operators import assign, enrich, planning, reports, resolve
from reelspark.operators.infer import MATCHED, TV, MediaSpec, infer, with_parts
from reelspark.operators.ordinals import with_row
from reelspark.session import discard, kept
from reelspark.sources.catalog import Catalog, TableCatalog
from reelspark.sources.tables import merge_series_ids


@dataclass(frozen=True)
class Options:
    """Parameters of a run. Steps that are off never enter the plan."""

    library: str = "/library"
    fetch: bool = True
    transform: bool = True
    rename: bool = True
    organize: bool = True
    simulate: bool = False
    mode: str = "644"
    owner: str | None = None
    group: str | None = None
    title_policy: str = "overwrite"
    #: Where the ID table of the run, known and newly resolved series, is written; nowhere if not given.
    learned: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "library", self.library.rstrip("/"))

    @classmethod
    def of(cls, general: dict, *sections: dict) -> Options:
        """Options of a media type: its own section over the general one."""
        known = {f.name for f in fields(cls)}
        merged = {k: v for layer in (general, *sections) for k, v in layer.items()}
        return replace(cls(), **{k: v for k, v in merged.items() if k in known})


@dataclass(frozen=True)
class Reference:
    """Reference tables of a run: alias and ID tables and the catalogue.

    ``index`` is the search index; built from the catalogue's shows unless given. ``rank`` is a
    ranking of candidates other than the score, ``choices`` (series_key, choice) what users picked,
    ``similarity`` the share of words from which a name is a candidate.
    """

    ids: DataFrame
    catalog: Catalog
    aliases: DataFrame | None = None
    index: DataFrame | None = None
    rank: Column | None = None
    choices: DataFrame | None = None
    similarity: float = resolve.SIMILARITY

    def search_index(self) -> DataFrame:
        return self.index if self.index is not None else resolve.name_index(self.catalog.shows())

    def kept(self, episodes: bool = True) -> Reference:
        """The same tables, worked out now and kept in the shared folder, for many runs over them."""
        catalog = self.catalog
        if episodes:
            catalog = TableCatalog(catalog.shows(), catalog.seasons(), kept(catalog.episodes(), "episodes"))
        aliases = self.aliases if self.aliases is None else kept(self.aliases, "aliases")
        return replace(self, ids=kept(self.ids, "ids"), catalog=catalog, aliases=aliases, index=kept(self.search_index(), "index"))

    def resolve(self, keys: DataFrame) -> DataFrame:
        """The ID of every distinct series, each looked up or searched once."""
        return resolve.resolve_series(keys, self.ids, self.search_index(), self.rank, self.choices, self.similarity)


def named(files: DataFrame, reference: Reference, options: Options, spec: MediaSpec) -> DataFrame:
    """File status, inferred fields and preferred series spelling of each file."""
    usable = files.withColumn(
        "file_status", planning.file_status(F.col("path"), F.col("path_type"))
    )
    aliases = reference.aliases if options.transform else None
    return resolve.join_aliases(infer(usable, spec), aliases)


def resolution(rows: DataFrame, reference: Reference) -> DataFrame:
    """The ID of every distinct series in the rows, each looked up or searched once."""
    return reference.resolve(resolve.series_keys(rows))


def fetched(rows: DataFrame, reference: Reference, options: Options) -> DataFrame:
    """The fetch step, or its columns left empty where fetching is off.

    The rows are kept as Parquet first: the distinct series and the rows both come from them, so that every name
    is parsed once.
    """
    return _fetched(rows, reference, options)[0]


def _fetched(rows: DataFrame, reference: Reference, options: Options) -> tuple[DataFrame, list[DataFrame]]:
    """``fetched``, and the scratch tables it reads."""
    if not options.fetch:
        return rows.withColumns(
            {
                "series_id": F.lit(0),
                "id_source": F.lit("none"),
                "fetch_status": F.lit(None).cast("string"),
            }
        ), []
    rows = written(rows, "named")
    known = written(resolution(rows, reference), "resolution")
    if options.learned:
        merge_series_ids(reference.ids, known.select("series_key", "series_id")).write.parquet(options.learned)
    return enrich.enrich(rows, known, reference.catalog.episodes(), options.title_policy), [rows, known]


def written(table: DataFrame, label: str) -> DataFrame:
    """The table, run now and kept as Parquet in the shared folder.

    The names are then resolved once, whatever is lost or retried later, and the planner
    knows the true size of the table when it chooses between broadcast and shuffle.
    """
    return kept(table, label)


def infer_report(
    files: DataFrame, reference: Reference, options: Options | None = None, spec: MediaSpec = TV
) -> DataFrame:
    """Infer and fetch only: the display name of each file. Nothing is planned.

    With fetching on, the parsed names are kept as Parquet, but for ``parts``, which are read off the paths again
    where they are asked for.
    """
    rows, _ = _inferred(files, reference, options or Options(), spec)
    return with_parts(rows, spec)


def _inferred(
    files: DataFrame, reference: Reference, options: Options, spec: MediaSpec
) -> tuple[DataFrame, list[DataFrame]]:
    """``infer_report`` without ``parts``, and the scratch tables it reads."""
    rows, scratch = _fetched(named(files, reference, options, spec).drop("parts"), reference, options)
    return rows.withColumn("display_name", _display(spec)), scratch


def _display(spec: MediaSpec) -> Column:
    return spec.display(*map(F.col, ("series", "season", "episode", "title")))


def process(
    files: DataFrame,
    reference: Reference,
    options: Options | None = None,
    listing: DataFrame | None = None,
    spec: MediaSpec = TV,
    grants: Mapping[str, planning.Grant] | None = None,
) -> DataFrame:
    """The whole run: infer, alias, fetch, rename, organise, attributes.

    With fetching on, names are parsed and the distinct series resolved at once, and kept as
    tables; so are the rows with their targets, and the winners of the claims. The rest is one lazy
    plan that moves the rows once.

    ``listing`` holds the paths that exist on disk. A file that cannot be planned keeps its
    row, with the first reason in ``status``; the others go on. ``grants`` says what earlier runs left of
    the targets of ``rename`` and ``organize``; a run without them keeps the listing as a table of its own first,
    since both steps read it.
    """
    options, grants = options or Options(), grants or {}
    rows, scratch = _inferred(files, reference, options, spec)
    failed = F.col("fetch_status").isin(enrich.NO_SERIES_ID, enrich.NO_SEASON, enrich.NO_EPISODE)
    error = (
        F.when(F.col("file_status").isin("empty_path", "missing"), F.col("file_status"))
        .when(F.col("infer_status") != MATCHED, F.col("infer_status"))
        .when(failed, F.col("fetch_status"))
        .when(~paths.is_one_name(F.col("display_name")), "invalid_name")
    )
    rows = rows.withColumn("_error", error)
    planned = F.col("_error").isNull()

    target = F.when(planned, paths.rename_target(F.col("path"), F.col("display_name")))
    rows = rows.withColumn("rename_target", target if options.rename else _none())
    if options.rename or options.organize:
        # Both claims, and the plan, read these rows: what neither needs is not kept.
        rows = with_row(rows.select(
            "path", "input_ord", "path_type", "series", "series_id", "season", "episode", "title", "display_name",
            "rename_target", "infer_status", "alias_status", "fetch_status", "_error",
        ))
        for table in scratch:  # nothing reads them any more
            discard(table)
        if listing is not None and not grants:
            listing = written(listing.select("path"), "listing")
    if options.rename:
        rows = planning.rename_action(rows, listing, options.simulate, grants.get("rename"))
    else:
        rows = rows.withColumn("rename_action", _none())

    renamed = F.col("rename_action").isin("rename", "simulated")
    current = F.when(renamed, F.col("rename_target")).otherwise(F.col("path"))
    folder = spec.folder(F.lit(options.library), F.col("series"), F.col("season"))
    moved = F.when(planned, paths.in_folder(folder, paths.base_name(current)))
    rows = rows.withColumn("organize_target", moved if options.organize else _none())
    if options.organize:
        # Places are inside the library, so only what is there can be in the way.
        inside = F.col("path").startswith(f"{options.library}/")
        places = None if listing is None else listing.select("path").filter(inside)
        rows = planning.organize_action(rows, places, options.simulate, grants.get("organize"))
    else:
        rows = rows.withColumn("organize_action", _none())
    if listing is not None and not grants and (options.rename or options.organize):
        discard(listing)  # both claims are settled

    conflict = (F.col("rename_action") == "conflict") | (F.col("organize_action") == "conflict")
    status = F.coalesce(
        "_error",
        F.when(F.col("organize_action") == "not_a_file", "not_a_file"),
        F.when(F.coalesce(conflict, F.lit(False)), "conflict"),
        F.lit("planned"),
    )
    attributes = planning.plan_attrs(options.mode, options.owner, options.group)
    if not options.organize:
        attributes = {name: F.lit(None).cast(kind) for name, kind in
                      (("mode", "int"), ("owner", "string"), ("group", "string"))}
    return rows.withColumns({**attributes, "status": status}).select(
        "path", "input_ord", "series", "series_id", "season", "episode", "title",
        "display_name", "rename_target", "rename_action", "organize_target", "organize_action",
        "mode", "owner", "group", "infer_status", "alias_status", "fetch_status", "status",
    )


def _none() -> Column:
    return F.lit(None).cast("string")


def dispatch(requests: DataFrame, reference: Reference) -> DataFrame:
    """Checks lookup requests, resolves their series and names the most specific answer.

    Adds ``reason`` (null where accepted), ``found_id`` and ``granularity``.
    """
    checked = requests.withColumn("reason", assign.lookup_reason())
    by_name = F.when(F.col("reason").isNull() & assign.given("series"), F.col("series"))
    asked = checked.withColumn("_series", F.coalesce(by_name, F.lit("")))
    ids = reference.resolve(resolve.series_keys(asked, "_series")).withColumnRenamed("series_id", "found_id")
    found = resolve.attach(
        asked, ids, {"series_key": F.nullif(resolve.name_key(F.col("_series")), F.lit(""))}, ["found_id"]
    )
    own = F.when(assign.given("series_id"), F.col("series_id")).otherwise(F.lit(0))
    found_id = F.when(F.col("reason").isNull(), F.coalesce("found_id", own)).otherwise(F.lit(0))
    known = F.col("found_id") != 0
    return found.withColumn("found_id", found_id).drop("_series").withColumn(
        "granularity",
        F.when(known & assign.given("season") & assign.given("episode"), "episode")
        .when(known & assign.given("season"), "season")
        .when(known, "series")
        .otherwise("none"),
    )


def fetch_report(requests: DataFrame, reference: Reference, raw: bool = False) -> DataFrame:
    """The text each lookup request asks for: ``request_id, granularity, part, text, status``.

    A season is one row per episode, ``part`` giving their order; all else is part 1. Season
    texts are made only for seasons some request asks for. Requests are checked and resolved
    once, and kept as a table. ``raw`` asks for the catalogue's records as they came instead of our text;
    the catalogue must be a ``RawCatalog``.
    """
    catalog = reference.catalog
    routed = written(
        dispatch(requests, reference).select(
            "request_id", "reason", F.col("found_id").alias("series_id"), "season", "episode", "granularity"
        ),
        "routed",
    )
    only = lambda kind: routed.filter(F.col("granularity") == kind)

    wanted = only("season").select("series_id", "season").distinct()
    if raw:
        episodes, by_season, by_episode = catalog.raw_episodes(), reports.raw_season_report, reports.raw_episode_report
        series = catalog.raw_shows().withColumnRenamed("show_id", "series_id")
    else:
        episodes, by_season, by_episode = catalog.episodes(), reports.season_report, reports.episode_report
        series = reports.series_report(catalog.shows())
    seasons = by_season(episodes.join(wanted, ["series_id", "season"], "left_semi")).withColumnRenamed("idx", "part")
    answers = [
        only("episode").join(by_episode(episodes), ["series_id", "season", "episode"], "left"),
        only("season").join(seasons, ["series_id", "season"], "left"),
        only("series").join(series, "series_id", "left"),
        only("none"),
    ]
    refused = F.coalesce("reason", F.lit("nothing_found"))
    rows = None
    for answer in answers:
        part = F.col("part") if "part" in answer.columns else F.lit(1)
        text = F.col("text") if "text" in answer.columns else _none()
        one = answer.select(
            "request_id", "granularity",
            F.coalesce(part, F.lit(1)).cast("bigint").alias("part"), text.alias("text"),
            F.when(F.col("granularity") == "none", refused)
            .when(text.isNull(), F.concat(F.col("granularity"), F.lit("_not_found")))
            .otherwise("ok")
            .alias("status"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def accepted_assignments(requests: DataFrame, files: DataFrame, reference: Reference) -> DataFrame:
    """Assignment requests with ``n_files``, ``series_id`` and ``reason`` (null where accepted)."""
    counted = assign.file_counts(requests, files).withColumn("reason", assign.assignment_reason())
    ids = reference.resolve(resolve.series_keys(counted.withColumn("series", F.coalesce("series", F.lit("")))))
    found = enrich.join_resolution(counted, ids)
    unknown = F.when(F.col("series_id") == 0, "no_series_id").when(
        ~assign.given("season"), "no_season"
    )
    return found.withColumn("reason", F.coalesce("reason", unknown))


def apply(
    files: DataFrame,
    requests: DataFrame,
    reference: Reference,
    listing: DataFrame | None = None,
    simulate: bool = False,
) -> DataFrame:
    """Assignments to files: single episodes by number, seasons by position. Never organises.

    ``requests``: request_id, series, season, episode; ``files``: request_id, path. Requests are
    checked and resolved once, and kept as a table. Every assigned file keeps a row: files of
    refused requests have the reason as their status and no target. ``rename_action`` is as in a run;
    claims on one target are settled by request, then by path.
    """
    checked = written(accepted_assignments(requests, files, reference), "assignments")
    accepted = checked.filter(F.col("reason").isNull())
    episodes = reference.catalog.episodes()
    refused = resolve.attach(
        files, checked.filter(F.col("reason").isNotNull()), {"request_id": F.col("request_id")},
        ["series", "series_id", "season", "episode", "reason"], "inner",
    ).select(
        "request_id", "path", "series", "series_id", "season", "episode", _none().alias("title"),
        _none().alias("rename_target"), F.col("reason").alias("status"),
    )
    assigned = (
        assign.apply_single(files, accepted, episodes)
        .unionByName(assign.apply_season(files, accepted, episodes))
        .unionByName(refused)
    )
    entered = assigned.withColumns({"path_type": F.lit("file"), "input_ord": F.col("request_id").cast("bigint")})
    listing = listing if listing is None else written(listing.select("path"), "listing")
    return planning.rename_action(entered, listing, simulate).drop("path_type", "input_ord")
