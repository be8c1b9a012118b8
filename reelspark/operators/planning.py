"""The rename and organise rules as plan columns, and the tally of what happened."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import paths
from reelspark.operators.ordinals import ROW, first_claims, with_row

# What earlier runs leave of the targets a run asks for; see first_claims.
Grant = Callable[[DataFrame], DataFrame]

# Claims on one path are settled in the order of the input, then by path.
CLAIM_ORDER = ("input_ord", "path")


def path_parts(path: Column) -> dict[str, Column]:
    name = paths.base_name(path)
    return {
        "parent": paths.parent(path),
        "name": name,
        "stem": paths.stem(name),
        "suffix": paths.suffix(name),
    }


def file_status(path: Column, path_type: Column) -> Column:
    """ok, or why a manifest entry cannot be processed."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty_path")
        .when(F.coalesce(path_type, F.lit("absent")) == "absent", "missing")
        .when(path_type != "file", "not_a_file")
        .otherwise("ok")
    )


def _claims(rows: DataFrame, target: str, taken: DataFrame | None = None, grant: Grant | None = None) -> DataFrame:
    """first_claims in CLAIM_ORDER as column ``_first``; rows without a number are written first."""
    numbered = rows if ROW in rows.columns else with_row(rows)
    claimed = first_claims(numbered, target, [F.col(c) for c in CLAIM_ORDER], "_first", taken, grant)
    return claimed if ROW in rows.columns else claimed.drop(ROW)


def dest_conflicts(rows: DataFrame, target: str) -> DataFrame:
    """Adds ``claim``: ``first`` for the first file to claim a path, ``conflict`` for the rest."""
    return _claims(rows, target).withColumn(
        "claim", F.when(F.col("_first"), "first").when(~F.col("_first"), "conflict")
    ).drop("_first")


def rename_action(
    rows: DataFrame, listing: DataFrame | None, simulate: bool = False, grant: Grant | None = None
) -> DataFrame:
    """Adds ``rename_action`` for rows that have ``path``, ``path_type`` and ``rename_target``.

    missing; already_named; conflict (the target exists, or an earlier file claims it);
    rename, or simulated in a dry run. Null where there is no target.
    """
    contest = F.when(F.col("rename_target") != F.col("path"), F.col("rename_target"))
    missing = file_status(F.col("path"), F.col("path_type")).isin("empty_path", "missing")
    entered = rows.withColumn("_wanted", F.when(~missing, contest))
    claimed = _claims(entered, "_wanted", listing, grant)
    action = (
        F.when(F.col("rename_target").isNull(), None)
        .when(missing, "missing")
        .when(F.col("rename_target") == F.col("path"), "already_named")
        .when(~F.col("_first"), "conflict")
        .otherwise("simulated" if simulate else "rename")
    )
    return claimed.withColumn("rename_action", action).drop("_wanted", "_first")


def organize_action(
    rows: DataFrame, listing: DataFrame | None, simulate: bool = False, grant: Grant | None = None
) -> DataFrame:
    """Adds ``organize_action`` for rows that have ``organize_target``: as for renaming.

    Only regular files are moved. A file that is in its place already is ``in_place``.
    """
    contest = F.when(F.col("organize_target") != F.col("path"), F.col("organize_target"))
    status = file_status(F.col("path"), F.col("path_type"))
    entered = rows.withColumn("_wanted", F.when(status == "ok", contest))
    claimed = _claims(entered, "_wanted", listing, grant)
    action = (
        F.when(F.col("organize_target").isNull(), None)
        .when(status != "ok", status)
        .when(F.col("organize_target") == F.col("path"), "in_place")
        .when(~F.col("_first"), "conflict")
        .otherwise("simulated" if simulate else "move")
    )
    return claimed.withColumn("organize_action", action).drop("_wanted", "_first")


def plan_attrs(mode: str, owner: str | None, group: str | None) -> dict[str, Column]:
    """File mode from octal text; owner and group only where they are set."""
    return {
        "mode": F.conv(F.lit(mode), 8, 10).cast("int"),
        "owner": F.lit(owner).cast("string"),
        "group": F.lit(group).cast("string"),
    }


def outcome_counts(rows: DataFrame, stages: dict[str, str]) -> DataFrame:
    """How many rows met which outcome, per stage: ``stage, status, n``.

    ``stages`` maps a stage name to its status column. The rows are read once; counts are
    combined before the shuffle.
    """
    events = F.array(
        *(
            F.struct(F.lit(stage).alias("stage"), F.col(column).alias("status"))
            for stage, column in stages.items()
        )
    )
    return (
        rows.select(F.explode(events).alias("event"))
        .select("event.*")
        .filter(F.col("status").isNotNull())
        .groupBy("stage", "status")
        .agg(F.count("*").alias("n"))
    )


# What a run can say of a file, by stage.
OUTCOMES = {
    "infer": ("infer_status", ("MATCHED", "NO_MATCH", "NO_PATTERNS")),
    "alias": ("alias_status", ("TRANSFORM", "NO_TRANSFORM_OPTION", "NO_TRANSFORM_SECTION")),
    "fetch": ("fetch_status", ("fetched", "episode_not_found", "no_series_id", "no_season", "no_episode")),
    "rename": ("rename_action", ("missing", "already_named", "conflict", "rename", "simulated")),
    "organize": (
        "organize_action", ("empty_path", "missing", "not_a_file", "in_place", "conflict", "move", "simulated"),
    ),
    "plan": (
        "status",
        ("planned", "conflict", "not_a_file", "empty_path", "missing", "NO_MATCH", "NO_PATTERNS", "no_series_id",
         "no_season", "no_episode", "invalid_name"),
    ),
}


def observed(plan: DataFrame) -> tuple[DataFrame, Observation]:
    """The plan, and an observation that counts its outcomes while whatever action comes first runs over it."""
    observation, counts = Observation(), []
    for stage, (column, statuses) in OUTCOMES.items():
        value = F.col(column)
        counts += [F.count(F.when(value == s, 1)).alias(f"{stage}|{s}") for s in statuses]
        counts.append(F.count(F.when(~value.isin(*statuses), 1)).alias(f"{stage}|other"))
    return plan.observe(observation, *counts), observation


def observed_counts(spark: SparkSession, observation: Observation) -> DataFrame:
    """``stage, status, n`` of an observation whose action has run; one row per outcome that occurred."""
    rows = [(*name.split("|"), n) for name, n in observation.get.items() if n]
    return spark.createDataFrame(rows, "stage string, status string, n bigint")
