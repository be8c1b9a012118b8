"""Media types by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from reelspark.operators.infer import TV, MediaSpec
from reelspark.plans.pipeline import Options, Reference, infer_report, process
from reelspark.sources.catalog import Catalog


@dataclass(frozen=True)
class Processor:
    """A media type and the catalogue its metadata comes from."""

    spec: MediaSpec
    reference: Reference

    def infer(self, files: DataFrame, options: Options | None = None) -> DataFrame:
        return infer_report(files, self.reference, options, self.spec)

    def process(
        self, files: DataFrame, options: Options | None = None, listing: DataFrame | None = None
    ) -> DataFrame:
        return process(files, self.reference, options, listing, self.spec)


MEDIA_TYPES: dict[str, MediaSpec] = {"tv": TV}


def processor(
    media_type: str,
    catalog: Catalog,
    ids: DataFrame,
    aliases: DataFrame | None = None,
    search: Callable[[DataFrame], DataFrame] | None = None,
    rank: Column | None = None,
    choices: DataFrame | None = None,
) -> Processor:
    """The processor of a media type; ``search`` may build another index than the default, ``rank`` rank otherwise."""
    index = search(catalog.shows()) if search else None
    return Processor(MEDIA_TYPES[media_type], Reference(ids, catalog, aliases, index, rank, choices))
