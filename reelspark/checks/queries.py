"""One query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.checks import inputs
from reelspark.functions import html, labels, paths, text
from reelspark.operators import assign, enrich, ordinals, planning, reports, resolve
from reelspark.operators.infer import TV, infer, metadata_struct, unmatched
from reelspark.plans import pipeline
from reelspark.plans.pipeline import Options, Reference
from reelspark.plans.registry import processor
from reelspark.session import discard, kept, remove, scratch_path, tune
from reelspark.sources import catalog, tables
from reelspark.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
OPTIONS = Options(owner="media")
SERVICE = "https://catalogue.example"


class Inputs:
    """The derived inputs of one query run."""

    def __init__(self, spark: SparkSession, sf_dir: str, replaced: dict[str, str] | None = None):
        self.spark, self.sf_dir, self.replaced = tune(spark), sf_dir, replaced
        self._views: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = inputs.view(self.spark, self.sf_dir, name, self.replaced)
        return self._views[name]

    def sql(self, body: str) -> DataFrame:
        return inputs.query(self.spark, self.sf_dir, body, self.replaced)

    def files(self) -> DataFrame:
        return self["files"].select("path", "input_ord", "path_type")

    def named(self) -> DataFrame:
        return infer(self.files())

    def aliased(self) -> DataFrame:
        return resolve.join_aliases(self.named(), self.aliases())

    def aliases(self) -> DataFrame:
        layers = self["alias_layers"].withColumn("variant_key", text.name_key(F.col("variant")))
        return tables.overlay(layers, "variant_key", "preferred", ["layer", "line"])

    def ids(self) -> DataFrame:
        return tables.series_id_table(self["known_ids"])

    def shows(self) -> DataFrame:
        return self["shows"].select("show_id", "name")

    def index(self) -> DataFrame:
        return resolve.name_index(self.shows())

    def candidates(self) -> DataFrame:
        return resolve.search_candidates(self["searches"], self.index())

    def hits(self) -> DataFrame:
        return catalog.parse_search_results(self["search_payloads"])

    def payload_catalog(self) -> catalog.PayloadCatalog:
        """The catalogue as read from JSON payloads."""
        return catalog.PayloadCatalog(self["show_payloads"], self["season_payloads"], self["episode_payloads"])

    def table_catalog(self) -> catalog.TableCatalog:
        """The catalogue as plain tables."""
        episodes = self["episodes"].select(
            F.col("show_id").alias("series_id"), "season", "episode", "episode_id", "title",
            F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("summary"),
        )
        seasons = catalog.parse_seasons(self["season_payloads"])
        return catalog.TableCatalog(self.shows(), seasons, episodes)

    def reference(self) -> Reference:
        return Reference(self.ids(), self.table_catalog(), self.aliases(), self.index())

    def payload_reference(self) -> Reference:
        return Reference(self.ids(), self.payload_catalog(), index=self.index())

    def enriched(self) -> DataFrame:
        return pipeline.fetched(self.aliased().drop("parts"), self.reference(), OPTIONS)

    def resolution(self) -> DataFrame:
        return resolve.resolve_series(resolve.series_keys(self.aliased()), self.ids(), self.index())

    def processed(self) -> DataFrame:
        run = processor("tv", self.table_catalog(), self.ids(), self.aliases())
        return run.process(self.files(), OPTIONS, self["listing"])

    def assigned_files(self) -> DataFrame:
        return self["files"].select("request_id", "path")

    def accepted(self) -> DataFrame:
        return pipeline.accepted_assignments(
            self["assignments"], self.assigned_files(), self.payload_reference()
        )


def register(make: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Inputs(spark, sf_dir))
    return make


# Sources and sinks ----------------------------------------------------------------------


@register
def scan_files(i: Inputs) -> DataFrame:
    return i.files()


@register
def scan_aliases(i: Inputs) -> DataFrame:
    layers = i["alias_layers"]
    return layers.select("layer", "line", text.name_key(F.col("variant")).alias("variant_key"), "preferred")


@register
def scan_series_ids(i: Inputs) -> DataFrame:
    return i.ids()


@register
def scan_catalog_shows(i: Inputs) -> DataFrame:
    return i.payload_catalog().shows().select(
        "show_id", "name", "show.url", "show.premiered", "show.status", "show.type",
        F.col("show.network.name").alias("network"),
        F.col("show.webChannel.name").alias("web_channel"),
        F.get("show.genres", 1).alias("genre"),
        F.col("show.rating.average").alias("rating"),
    )


@register
def scan_catalog_seasons(i: Inputs) -> DataFrame:
    return i.payload_catalog().seasons().withColumns(
        {
            "network": F.col("network.name"), "web_country": F.col("web_channel.country.name"),
            "image": F.col("image.medium"),
        }
    ).drop("web_channel")


@register
def scan_catalog_episodes(i: Inputs) -> DataFrame:
    return i.payload_catalog().episodes().drop("air_time")


@register
def scan_search_results(i: Inputs) -> DataFrame:
    return i.hits().select(
        "query", "number", "score", F.col("show.id").alias("show_id"), F.col("show.name").alias("name")
    )


@register
def raw_payload(i: Inputs) -> DataFrame:
    return i.payload_catalog().raw_episodes().drop("episode_id")


@register
def sink_plan(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "plan")
    plan = i.processed()
    tables.write_plan(plan, path)
    return i.spark.read.parquet(path).select(*plan.columns)


@register
def merge_series_ids(i: Inputs) -> DataFrame:
    return tables.merge_series_ids(i.ids(), i.resolution().select("series_key", "series_id"))


# Projections ----------------------------------------------------------------------------


@register
def path_parts(i: Inputs) -> DataFrame:
    parts = planning.path_parts(F.col("path"))
    return i.files().select("path", *(value.alias(name) for name, value in parts.items()))


@register
def valid_files(i: Inputs) -> DataFrame:
    status = planning.file_status(F.col("path"), F.col("path_type"))
    return i.files().select("path", status.alias("status"))


@register
def infer_(i: Inputs) -> DataFrame:
    return i.named().select("path", "parts.*")


QUERIES["infer"] = QUERIES.pop("infer_")


@register
def infer_unmatched(i: Inputs) -> DataFrame:
    return unmatched(i.named()).select("path", "infer_status")


@register
def metadata_struct_(i: Inputs) -> DataFrame:
    return i.named().select("path", F.to_json(metadata_struct()).alias("metadata"))


QUERIES["metadata_struct"] = QUERIES.pop("metadata_struct_")


@register
def numeric_fields(i: Inputs) -> DataFrame:
    return i.named().select("path", "season", "episode")


@register
def normalize_series(i: Inputs) -> DataFrame:
    return i.named().select("path", "series")


@register
def normalize_title(i: Inputs) -> DataFrame:
    return i.named().select("path", "title")


def _display() -> Column:
    return TV.display(*map(F.col, ("series", "season", "episode", "title")))


@register
def display_name(i: Inputs) -> DataFrame:
    return i.named().select("path", _display().alias("display_name"))


def _folder() -> Column:
    return TV.folder(F.lit("/library"), F.col("series"), F.col("season"))


@register
def target_dir(i: Inputs) -> DataFrame:
    return i.named().select("path", _folder().alias("target_dir"))


@register
def rename_target(i: Inputs) -> DataFrame:
    return i.named().select("path", paths.rename_target(F.col("path"), _display()).alias("rename_target"))


@register
def organize_target(i: Inputs) -> DataFrame:
    place = paths.in_folder(_folder(), paths.base_name(F.col("path")))
    return i.named().select("path", place.alias("organize_target"))


@register
def rename_action(i: Inputs) -> DataFrame:
    target = paths.rename_target(F.col("path"), _display()).alias("rename_target")
    rows = i.named().select("path", "input_ord", "path_type", target)  # no more than this is kept
    return planning.rename_action(rows, kept(i["listing"], "listing")).select("path", "rename_target", "rename_action")


@register
def plan_attrs(i: Inputs) -> DataFrame:
    return i.files().select("path").withColumns(planning.plan_attrs("644", "media", None))


@register
def step_toggles(i: Inputs) -> DataFrame:
    """The same files with steps left out; what is off is not in the plan."""
    general = {"fetch": False, "organize": False}
    runs = {
        "infer only": Options.of(general, {"rename": False}),
        "rename only": Options.of(general),
    }
    rows = None
    for name, options in runs.items():
        plan = pipeline.process(i.files(), i.reference(), options, i["listing"])
        one = plan.select(
            F.lit(name).alias("toggles"), "path", "display_name", "rename_target", "organize_target", "status"
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@register
def lookup_errors(i: Inputs) -> DataFrame:
    rows = enrich.join_resolution(i.aliased(), i.resolution())
    return rows.select("path", enrich.lookup_error().alias("lookup_error"))


@register
def request_validate(i: Inputs) -> DataFrame:
    return i["requests"].select("request_id", assign.lookup_reason().alias("reason"))


@register
def assignment_validate(i: Inputs) -> DataFrame:
    return i.accepted().select("request_id", "n_files", "series_id", "reason")


@register
def request_dispatch(i: Inputs) -> DataFrame:
    return pipeline.dispatch(i["requests"], i.payload_reference()).select(
        "request_id", "found_id", "granularity", "reason"
    )


# Joins ----------------------------------------------------------------------------------


@register
def join_aliases(i: Inputs) -> DataFrame:
    return i.aliased().select("path", "series", "alias_status")


@register
def join_local_ids(i: Inputs) -> DataFrame:
    return resolve.join_local_ids(i.aliased(), i.ids()).select("path", "series", "local_id")


@register
def unresolved_series(i: Inputs) -> DataFrame:
    return resolve.unresolved_series(i.aliased(), i.ids())


@register
def search_candidates(i: Inputs) -> DataFrame:
    return i.candidates()


@register
def resolve_best(i: Inputs) -> DataFrame:
    return resolve.resolve_best(resolve.unresolved_series(i.aliased(), i.ids()), i.index())


@register
def resolve_series_id(i: Inputs) -> DataFrame:
    return i.resolution()


@register
def join_show(i: Inputs) -> DataFrame:
    rows = i["files"].select("path", F.col("show_id").alias("series_id"))
    return enrich.join_show(rows, i.payload_catalog().shows()).select(
        "path", "series_id", "show.name", "show.url", "show.premiered"
    )


@register
def join_show_seasons(i: Inputs) -> DataFrame:
    rows = i["shows"].select(F.col("show_id").alias("series_id"))
    joined = enrich.join_show_seasons(rows, i.payload_catalog().seasons())
    return joined.select("series_id", "ord", "season_id", "season")


@register
def season_id(i: Inputs) -> DataFrame:
    rows = i["files"].select("path", F.col("show_id").alias("series_id"), F.col("true_season").alias("season"))
    return enrich.season_id(rows, i.payload_catalog().seasons()).select("path", "season_id")


@register
def season_episodes(i: Inputs) -> DataFrame:
    asked = pipeline.dispatch(i["requests"], i.payload_reference())
    asked = asked.filter(F.col("granularity") == "season").select(
        "request_id", F.col("found_id").alias("series_id"), "season"
    )
    return enrich.season_episodes(asked, i.payload_catalog().episodes()).select(
        "request_id", "season", "episode", "title"
    )


@register
def episode_title(i: Inputs) -> DataFrame:
    rows = i["files"].select(
        "path", F.col("show_id").alias("series_id"),
        F.col("true_season").alias("season"), F.col("true_episode").alias("episode"),
    )
    return enrich.episode_title(rows, i.payload_catalog().episodes()).select(
        "path", "fetched_title", "fetch_status"
    )


@register
def enrich_(i: Inputs) -> DataFrame:
    return i.enriched().select("path", "series_id", "id_source", "title", "fetch_status")


QUERIES["enrich"] = QUERIES.pop("enrich_")


@register
def apply_single(i: Inputs) -> DataFrame:
    good = i.accepted().filter(F.col("reason").isNull())
    return assign.apply_single(i.assigned_files(), good, i.payload_catalog().episodes())


@register
def apply_season(i: Inputs) -> DataFrame:
    good = kept(i.accepted().filter(F.col("reason").isNull()), "accepted")  # what they were searched by goes first
    return assign.apply_season(i.assigned_files(), good, i.payload_catalog().episodes())


# Aggregations ---------------------------------------------------------------------------


@register
def candidate_count(i: Inputs) -> DataFrame:
    return resolve.candidate_count(i["searches"], resolve.search_candidates(i["searches"], i.index(), counted=True))


@register
def season_report(i: Inputs) -> DataFrame:
    return reports.season_report(i.payload_catalog().episodes())


@register
def overlay_aliases(i: Inputs) -> DataFrame:
    return i.aliases()


@register
def outcome_counts(i: Inputs) -> DataFrame:
    plan, counts = planning.observed(i.processed())
    tables.write_plan(plan, scratch_path(i.spark, "plan"))
    return planning.observed_counts(i.spark, counts)


# Numbering and order --------------------------------------------------------------------


@register
def number_candidates(i: Inputs) -> DataFrame:
    return resolve.number_candidates(i.candidates()).drop("n_shows")


@register
def top1_per_query(i: Inputs) -> DataFrame:
    return resolve.top_candidate(resolve.search_candidates(i["searches"], i.index(), leading=True))


@register
def pick_nth(i: Inputs) -> DataFrame:
    return resolve.pick_nth(i.hits(), i["choices"])


@register
def dest_conflicts(i: Inputs) -> DataFrame:
    name = F.concat(_display(), paths.suffix(paths.base_name(F.col("path"))))
    rows = i.named().select("path", "input_ord", paths.in_folder(_folder(), name).alias("target"))
    return planning.dest_conflicts(rows, "target").select("path", "target", "claim")


@register
def apply_ordinals(i: Inputs) -> DataFrame:
    return assign.apply_ordinals(i.assigned_files()).select("request_id", "path", "idx")


@register
def order_tv(i: Inputs) -> DataFrame:
    rows = i.named().select("path", "series", F.lit(0).alias("series_id"), "season", "episode", "title")
    return ordinals.number_rows(rows, assign.order_key(), name="rank").select(
        "path", "series", "season", "episode", "title", "rank"
    )


@register
def natural_sort(i: Inputs) -> DataFrame:
    title = F.when(F.col("true_title") == "", "").otherwise(F.concat(F.lit(" "), "true_title"))
    rows = i["files"].select(
        "path", F.concat(F.col("true_episode").cast("string"), title, F.lit(".mkv")).alias("filename")
    )
    return assign.number_naturally(rows, F.col("filename"), [], "rank").select("filename", "path", "rank")


@register
def first_or_default(i: Inputs) -> DataFrame:
    hits = i.hits().select("query", "number", F.col("show.id").alias("series_id"))
    return enrich.first_or_default(hits, ["query"], ["number"], "series_id", i["search_payloads"])


# Functions ------------------------------------------------------------------------------


@register
def title_case(i: Inputs) -> DataFrame:
    return i["documents"].select("doc_id", text.title_case(F.col("text")).alias("titled"))


@register
def cap_words(i: Inputs) -> DataFrame:
    return i["documents"].select("doc_id", text.cap_words(F.col("text")).alias("capped"))


@register
def strip_release_tags(i: Inputs) -> DataFrame:
    return i["files"].select("path", text.strip_release_tags(F.col("filename")).alias("cut"))


@register
def strip_tags(i: Inputs) -> DataFrame:
    return i["pages"].select("page_id", html.strip_tags(F.col("html")).alias("text"))


@register
def strip_tags_exact(i: Inputs) -> DataFrame:
    return i["pages"].select("page_id", html.strip_tags_exact("html").alias("text"))


@register
def lookup_url(i: Inputs) -> DataFrame:
    name = F.concat(
        "name", F.lit(" & "), "p_type", F.lit("*~"), F.col("p_size").cast("string"), F.lit("/"), "channel"
    )
    urls = labels.lookup_urls(
        SERVICE, name, F.col("show_id"), F.col("p_size"), F.lit(2), F.col("show_id") * 10 + 1
    )
    return i.sql("select * from shows join channels on show_id = channel_of").select("show_id", *(url.alias(kind) for kind, url in urls.items()))


@register
def network_country(i: Inputs) -> DataFrame:
    show = F.col("show")
    return i.payload_catalog().shows().select(
        "show_id", labels.network_name(show).alias("network"), labels.network_country(show).alias("country")
    )


@register
def candidate_label(i: Inputs) -> DataFrame:
    return i.hits().select(
        "query", "number", labels.candidate_label(F.col("number"), F.col("show")).alias("label")
    )


@register
def series_text(i: Inputs) -> DataFrame:
    return reports.series_report(i.payload_catalog().shows())


@register
def episode_text(i: Inputs) -> DataFrame:
    return reports.episode_report(i.payload_catalog().episodes())


# Streaming ------------------------------------------------------------------------------


def _landed(i: Inputs, slices: int = 3) -> str:
    """A folder where the manifest has landed in slices of the input order, ``cores`` files each."""
    folder, files = scratch_path(i.spark, "landed"), kept(i.files(), "manifest")  # once, not anew for every slice
    low, high = files.agg(F.min("input_ord"), F.max("input_ord")).first()
    part = F.floor((F.col("input_ord") - low) * slices / (high - low + 1))
    for n in range(slices):
        files.filter(part == n).repartition(i.spark.sparkContext.defaultParallelism).write.option("compression", "zstd").mode("append").parquet(folder)
    discard(files)
    return folder


def stream_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches, the later of which meet what the earlier ones claimed."""
    i = Inputs(spark, sf_dir)
    files = arrivals.manifest_stream(spark, _landed(i), spark.sparkContext.defaultParallelism)
    sink, state = scratch_path(spark, "stream-plan"), scratch_path(spark, "stream-state")
    arrivals.stream_plan(files, i.reference(), sink, state, OPTIONS, i["listing"]).awaitTermination()
    return spark.read.parquet(sink).drop("version")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three slices of announcements, each met by queries started anew from their checkpoints.

    A row per path announced in time, and one per path with late announcements, with their number.
    """
    announced, columns = Inputs(spark, sf_dir)["announcements"], "path string, seen timestamp"
    landed, split, sink = (scratch_path(spark, f"dedup-{name}") for name in ("landed", "split", "sink"))
    states = [scratch_path(spark, "stream-state") for _ in range(2)]
    dealt = scratch_path(spark, "dedup-dealt")
    announced.write.option("compression", "zstd").partitionBy("slice").parquet(dealt)  # once, not anew for every slice
    for part in range(3):
        slices = spark.read.schema(f"{columns}, slice int").parquet(dealt)
        slices.filter(F.col("slice") == part).select("path", "seen").write.option("compression", "zstd").mode("append").parquet(landed)
        remove(spark, f"{dealt}/slice={part}")
        stream = spark.readStream.schema(columns).parquet(landed)
        arrivals.split_late(stream, "seen", "7 days", split, states[0]).awaitTermination()
        (
            arrivals.dedup_arrivals(arrivals.timely(spark, split, columns), "seen", "7 days").select("path")
            .writeStream.format("parquet").option("compression", "zstd").option("path", sink).option("checkpointLocation", states[1])
            .trigger(availableNow=True).start().awaitTermination()
        )
    once = spark.read.schema("path string").parquet(sink).select("path", F.lit(False).alias("late"), F.lit(1).cast("long").alias("announced"))
    late = arrivals.late_rows(spark, split, columns).groupBy("path").agg(F.count("*").alias("announced"))
    return once.unionByName(late.withColumn("late", F.lit(True)))


def stream_learn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    files = arrivals.manifest_stream(spark, _landed(i), spark.sparkContext.defaultParallelism)
    sink, state = scratch_path(spark, "stream-ids"), scratch_path(spark, "stream-state")
    arrivals.stream_learn_ids(files, i.reference(), sink, state).awaitTermination()
    return arrivals.known_ids(spark, i.ids(), sink, 3)


QUERIES |= {
    "stream_plan": stream_plan,
    "stream_dedup": stream_dedup,
    "stream_learn_ids": stream_learn_ids,
}


# End to end -----------------------------------------------------------------------------


@register
def process(i: Inputs) -> DataFrame:
    return i.processed()


@register
def infer_report(i: Inputs) -> DataFrame:
    run = processor("tv", i.table_catalog(), i.ids(), i.aliases())
    return run.infer(i.files(), OPTIONS).select(
        "path", "series", "series_id", "season", "episode", "title", "display_name",
        "infer_status", "fetch_status",
    )


@register
def fetch_report(i: Inputs) -> DataFrame:
    return pipeline.fetch_report(i["requests"], i.payload_reference())


@register
def fetch_report_raw(i: Inputs) -> DataFrame:
    return pipeline.fetch_report(i["requests"], i.payload_reference(), raw=True)


@register
def apply(i: Inputs) -> DataFrame:
    return pipeline.apply(i.assigned_files(), i["assignments"], i.payload_reference(), i["listing"])
