"""Changes of tables as queries: upsert, cascade, expiry, retargeting, backfill. Each returns the table's new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table with the rows in place of those of the same key; the rows have one per key."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True)


def without_files(table: DataFrame, column: str, files: DataFrame, symbols_too: bool = True) -> DataFrame:
    """The table without rows whose column is one of the files (path), or a symbol of one."""
    owner = F.substring_index(F.col(column), "#", 1) if symbols_too else F.col(column)
    marked = table.withColumn("_owner", owner)
    return marked.join(files.select(F.col("path").alias("_owner")).distinct(), "_owner", "left_anti").drop("_owner")


def add_once(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key the table doesn't have, one per key, the smallest."""
    others = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(F.min(F.struct(*others)).alias("x")).select(*key, *(F.col(f"x.{c}").alias(c) for c in others)) if others else rows.select(*key).distinct()
    return one.join(table.select(*key).distinct(), list(key), "left_anti")


def expire(annotations: DataFrame, files: DataFrame, now: float, age: float | None = None) -> DataFrame:
    """Notes with expires_at set to now where they are older than age, or where they are on a file the index no longer has; what has expired stays."""
    path = F.substring_index("target", "#", 1)
    on_file = F.col("target").contains("/") & ~F.col("target").endswith("/")
    marked = annotations.withColumn("_path", F.when(on_file, path)).join(files.select(F.col("path").alias("_path"), F.lit(True).alias("_there")), "_path", "left")
    gone = F.col("_path").isNotNull() & F.col("_there").isNull()
    old = F.lit(False) if age is None else F.coalesce(F.col("created_at") < now - age, F.lit(False))
    due = (gone | old) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return marked.withColumn("expires_at", F.when(due, F.lit(now)).otherwise(F.col("expires_at"))).select(*annotations.columns)


def retarget(annotations: DataFrame, moves: DataFrame) -> DataFrame:
    """Notes with targets on moved files (old, new), also on their symbols, pointing to the new place."""
    owner = annotations.withColumn("_old", F.substring_index("target", "#", 1))
    joined = owner.join(moves.select(F.col("old").alias("_old"), F.col("new").alias("_new")), "_old", "left")
    target = F.when(F.col("_new").isNotNull(), F.concat("_new", F.expr("substring(target, length(_old) + 1)"))).otherwise(F.col("target"))
    return joined.withColumn("target", target).select(*annotations.columns)


def missing_lifelines(files: DataFrame, lifelines: DataFrame) -> DataFrame:
    """(id, current_path, created_at) for files without a living lifeline; the id is a hash of path and time, so a rerun gives the same."""
    live = lifelines.where("tombstoned_at is null and current_path is not null").select(F.col("current_path").alias("path")).distinct()
    new = files.select("path", F.col("indexed_at").alias("created_at")).join(live, "path", "left_anti")
    return new.select(F.sha1(F.concat_ws("|", "path", F.col("created_at").cast("string"))).alias("id"), F.col("path").alias("current_path"), "created_at")


def latest_version(log: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each key of an append-only log; others as large decide ties."""
    others = [c for c in log.columns if c not in key and c != order]
    return log.groupBy(*key).agg(F.max(F.struct(order, *others)).alias("x")).select(*key, *(F.col(f"x.{c}").alias(c) for c in (order, *others)))


def overdue(leases: DataFrame, now: float, ttl: float = 300.0) -> DataFrame:
    """(id, due) of open leases whose time is over: at expires_at, or ttl after they opened if that is unknown."""
    due = F.coalesce("expires_at", F.col("opened_at") + ttl)
    return leases.where((F.col("state") == "open") & (due <= now)).select("id", due.alias("due"))
