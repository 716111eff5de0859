"""Logs as streams: tails joined to lifelines, counts in event time, and labels that report only changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from codelode.operators.diffs import listing_diff


def tail(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """A log directory of Parquet files as a stream; the checkpoint of the query stands for the last id seen."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_lifelines(events: DataFrame, lifelines: DataFrame) -> DataFrame:
    """Events (lifeline_id, ...) with the path of their lifeline: a join of a stream with a table, which keeps no state."""
    return events.join(lifelines.select(F.col("id").alias("lifeline_id"), "current_path"), "lifeline_id", "left")


def once_within(events: DataFrame, key: str, time: str, late: str = "14 days") -> DataFrame:
    """Events delivered several times come once, as long as they are no later than `late`."""
    return events.withColumn("event_time", F.timestamp_seconds(time)).withWatermark("event_time", late).dropDuplicatesWithinWatermark([key])


def counts_per_window(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """(window, keys, events): counts in windows of event time; windows close `late` after the newest event."""
    timed = events.withColumn("event_time", F.timestamp_seconds(time)).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", window), *keys).agg(F.count("*").alias("events"))


def edit_sessions(edits: DataFrame, gap: str, late: str) -> DataFrame:
    """(session, path, edits): edits of a path that follow each other within a gap."""
    timed = edits.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)
    return timed.groupBy(F.session_window("event_time", gap), "path").agg(F.count("*").alias("edits"))


def _transitions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    out = []
    for pdf in batches:
        for label, at in zip(pdf["label"], pdf["at"]):
            if label != last:
                out.append((key[0], last, label, at))
                last = label
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(out, columns=["id", "before", "label", "at"])


def label_transitions(labels: DataFrame) -> DataFrame:
    """(id, before, label, at) each time the label of an id changes; labels (id, label, at) of one batch are taken as they come.

    The state is one label per id.
    """
    return labels.select(F.col("id").cast("string"), "label", F.col("at").cast("double")).groupBy("id").applyInPandasWithState(
        _transitions, "id string, before string, label string, at double", "label string", "append", GroupStateTimeout.NoTimeout
    )


def _expiries(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        due = state.get[0]
        state.remove()
        yield pd.DataFrame([(key[0], due)], columns=["id", "due"])
        return
    due = state.get[0] if state.exists else None
    closed = False
    for pdf in batches:
        closed = closed or bool(pdf["closed"].any())
        latest = pdf["due"].max()
        due = latest if due is None or latest > due else due
    if closed:
        if state.exists:
            state.remove()
    else:
        state.update((due,))
        state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([], columns=["id", "due"])


def lease_expiries(leases: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(id, due) of leases (id, at, due, closed) that event time passes before a row closes them.

    A later row may prolong a lease; a closed one never comes out. The state is one time per open lease.
    """
    timed = leases.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)
    return timed.select(F.col("id").cast("string"), "event_time", "due", "closed").groupBy("id").applyInPandasWithState(_expiries, "id string, due double", "due double", "append", GroupStateTimeout.EventTimeTimeout)


def sweep(spark: SparkSession, listing: Callable[[], DataFrame], known: Callable[[], DataFrame], emit: Callable[[DataFrame, int], None], seconds: int = 5):
    """Compares a listing (path, hash) with what is known every few seconds and hands the changes (path, change) to emit; returns the running query."""

    def step(_: DataFrame, batch: int) -> None:
        changes = listing_diff(known(), listing())
        if not changes.isEmpty():
            emit(changes, batch)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(step).start()


def recent(events: DataFrame, name: str):
    """The events of a stream in a table in memory, for small logs and tests; returns the query."""
    return events.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
