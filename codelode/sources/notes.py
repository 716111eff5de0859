"""Notes and evidence as JSON lines: reading with counts of bad rows, writing, and what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EVIDENCE = "file string, symbol string, target string, kind string, note string"
NOTE = "target string, kind string, body string, author string, created_at double, expires_at double, confidence double"


def note_hash(target: Column, kind: Column, body: Column) -> Column:
    e = F.lit("")
    return F.sha1(F.concat_ws("|", F.coalesce(target, e), F.coalesce(kind, e), F.coalesce(body, e)))


def read_evidence(lines: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, kind, note, state) of JSON lines (value): ok, bad (no JSON object), missing_target, or invalid_target (neither file nor symbol)."""
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", EVIDENCE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    rows = parsed.select(F.coalesce("x.file", "x.symbol", "x.target").alias("target"), "x.kind", "x.note", (F.col("x").isNull() | F.col("x._bad").isNotNull()).alias("bad"))
    known = files.select(F.col("path").alias("target")).union(symbols.where("name is not null").select("name")).union(symbols.where("symbol_id is not null").select("symbol_id")).distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("bad"), "bad").when(F.col("target").isNull() | (F.col("target") == ""), "missing_target").when(F.col("known"), "ok").otherwise("invalid_target")
    return rows.join(known, "target", "left").select("target", "kind", "note", state.alias("state"))


def new_notes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming notes (target, kind, body, ...) whose hash neither an existing note nor an earlier incoming one has; one row per hash."""
    key = note_hash(F.col("target"), F.col("kind"), F.col("body"))
    fresh = incoming.withColumn("hash", key).join(existing.select(key.alias("hash")).distinct(), "hash", "left_anti")
    others = [c for c in fresh.columns if c != "hash"]
    return fresh.groupBy("hash").agg(F.min(F.struct(*others)).alias("x")).select("hash", "x.*")


def exported(annotations: DataFrame) -> DataFrame:
    """(value): notes as JSON lines with their hash; null fields are left out."""
    columns = [c for c in annotations.columns]
    return annotations.select(F.to_json(F.struct(*columns, note_hash(F.col("target"), F.col("kind"), F.col("body")).alias("sha1"))).alias("value"))
