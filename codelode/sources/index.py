"""The tables of a code index as relations: repeated deliveries once, and the current state of files and symbols."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.operators.snapshot_diff import ordered_labels
from codelode.plans.scratch import cut
from codelode.plans.sizing import small_side
from codelode.sources.tables import table

FILE_COLUMNS = ("indexed_at", "hash", "mtime", "size", "lang", "parser", "stale", "lifeline_id")


def latest_files(files: DataFrame) -> DataFrame:
    """One row per path: that indexed last, the larger one of a tie; null paths are left out."""
    best = F.max(F.struct(*FILE_COLUMNS)).alias("x")
    return files.where("path is not null").groupBy("path").agg(best).select("path", "x.*")


def current_symbols(snapshots: DataFrame, labels: DataFrame) -> DataFrame:
    """(file, name, kind, line, symbol_id): the distinct symbols under the label that was taken last."""
    newest = ordered_labels(labels).orderBy(F.desc("pos")).select("label").limit(1)
    return snapshots.join(F.broadcast(newest), "label", "left_semi").select("file", "name", "kind", "line", "symbol_id").distinct()  # one row


class Index:
    """The relations of one index directory; rows that were delivered several times come once."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)

    def once(self, name: str, *columns: str) -> DataFrame:
        """Rows of a table with an id, each id once, with the columns asked only.

        A row that was delivered again is the same in all columns, so distinct rows of (id, columns) are
        those of distinct ids; filters on any of the columns reach the scan, and no other column is read.
        """
        return self.raw(name).select("id", *columns).distinct()

    @functools.cached_property
    def files(self) -> DataFrame:
        return latest_files(self.raw("files"))

    @functools.cached_property
    def symbols(self) -> DataFrame:
        return current_symbols(self.raw("symbol_snapshots"), self.raw("snapshot_labels"))

    @functools.cached_property
    def labels(self) -> DataFrame:
        return small_side(cut(ordered_labels(self.raw("snapshot_labels"))))

    @functools.cached_property
    def events(self) -> DataFrame:
        return self.raw("file_event").distinct()

    @functools.cached_property
    def leases(self) -> DataFrame:
        return self.raw("edit_lease").distinct()

    @functools.cached_property
    def edits(self) -> DataFrame:
        return self.raw("file_edits").distinct()

    @property
    def lifelines(self) -> DataFrame:
        return self.raw("file_lifeline")

    @property
    def texts(self) -> DataFrame:
        return self.raw("file_texts")
