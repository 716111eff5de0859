"""Fingerprints of what notes are about, drift since they were taken, contradictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.paths import is_artifact, parse_target
from codelode.operators.binding import binding_summary
from codelode.operators.lookups import alive
from codelode.operators.rollups import STALENESS_RANK, label_of, rank_of

# Labels, factors and phrases that results must equal.
DECAY = {"fresh": 1.0, "recovered": 1.0, "unknown": 0.75, "weakly_stale": 0.5, "strongly_stale": 0.25, "contradicted": 0.0}
SAFE_PHRASES = ("safe", "no bug", "no vulnerability", "verified-safe", "not exploitable", "cannot be exploited", "benign")
UNSAFE_PHRASES = ("bug", "unsafe", "vulnerability", "exploit", "crash", "memory corruption", "injection", "insecure")
KIND_POLARITY = {"verified-safe": "safe", "refute": "unsafe", "risk": "unsafe", "documented-footgun": "unsafe"}
KIND_CONFLICTS = (("verified-safe", "refute", "high"), ("verified-safe", "risk", "high"), ("verified-safe", "documented-footgun", "medium"), ("refute", "todo", "low"))
BUG_MARKERS = r"\bBUG\b|\bFIXME\b|\bSECURITY\b|\bXXX\b|# ?TODO:?\s*(fix|security|insecure)"
HASHES = ("file_hash", "symbol_hash", "callers_hash", "contracts_hash")
# End of fixed values.


def set_hash(values: Column) -> Column:
    """SHA-1 of the sorted distinct values, one a line."""
    return F.sha1(F.array_join(F.array_sort(values), "\n"))


def callers_hash(refs: DataFrame) -> DataFrame:
    """(name, callers, callers_hash) of each name's set of referring files: it changes only when the set does.

    Only files are collected, each once: distinct pairs first, so a hot name brings as many values as it has files.
    """
    pairs = refs.where("name is not null and file is not null").select("name", "file").distinct()
    return pairs.groupBy("name").agg(F.count("*").alias("callers"), set_hash(F.collect_list("file")).alias("callers_hash"))


def fingerprints(targets: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """(target, file_hash, callers_hash) as they are now for each distinct target."""
    asked = targets.where("target is not null").select("target").distinct().withColumn("x", parse_target(F.col("target"))).select("target", "x.file", "x.name")
    hashes = files.select(F.col("path").alias("file"), F.col("hash").alias("file_hash"))
    callers = callers_hash(refs.join(asked.where("name is not null").select("name").distinct(), "name", "left_semi")).drop("callers")
    return asked.join(hashes, "file", "left").join(callers, "name", "left").select("target", "file_hash", "callers_hash")


def drifted(old: Column, now: dict[str, Column]) -> Column:
    """How many hashes had a value and have another one, or none, now; old: a struct of hashes."""
    total = F.lit(0)
    for name, value in now.items():
        before = old[name]
        total = total + F.when(before.isNotNull() & ~before.eqNullSafe(value), 1).otherwise(0)
    return total


def staleness(drift: Column) -> Column:
    return F.when(drift == 0, "fresh").when(drift == 1, "weakly_stale").otherwise("strongly_stale")


def revalidate(annotations: DataFrame, now: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(id, previous, staleness, confidence): notes against current fingerprints (target, file_hash, callers_hash).

    A note without a fingerprint is unknown. One that was stale and matches again has recovered. What
    its claims (id, status) say holds if it is worse. A contradicted refutation stays so. confidence is
    the base confidence (else the present one) times the decay of the label.
    """
    joined = annotations.join(now, "target", "left")
    drift = drifted(F.col("fingerprint"), {"file_hash": F.col("file_hash"), "callers_hash": F.col("callers_hash")})
    label = F.when(F.col("fingerprint").isNull(), "unknown").otherwise(staleness(drift))
    label = F.when((label == "fresh") & F.col("staleness").isin("weakly_stale", "strongly_stale", "contradicted"), "recovered").otherwise(label)
    if claims is not None:
        joined = joined.join(claims.select("id", F.col("status").alias("said")), "id", "left")
        worse = F.greatest(rank_of(label, STALENESS_RANK), F.when(F.col("said").isNull() | (F.col("said") == "unknown"), 0).otherwise(rank_of(F.col("said"), STALENESS_RANK)))
        label = label_of(worse, STALENESS_RANK)
    label = F.when((F.col("kind") == "refute") & (F.col("staleness") == "contradicted"), "contradicted").otherwise(label)
    out = joined.withColumn("now", label)
    decay = F.create_map(*(F.lit(x) for pair in DECAY.items() for x in pair))[F.col("now")]
    return out.select("id", F.col("staleness").alias("previous"), F.col("now").alias("staleness"), (F.coalesce("confidence_base", "confidence") * decay).alias("confidence"))


def polarity(body: Column) -> Column:
    """`safe` or `unsafe` by the phrases of a text, null for neither or both."""
    low = F.lower(F.coalesce(body, F.lit("")))
    has = lambda phrases: low.rlike("|".join(phrases))
    safe, unsafe = has(SAFE_PHRASES), has(UNSAFE_PHRASES)
    return F.when(safe & ~unsafe, "safe").when(unsafe & ~safe, "unsafe")


def code_polarity(texts: DataFrame) -> DataFrame:
    """(path, code): `unsafe` for files with a bug marker."""
    return texts.where(F.col("text").rlike(BUG_MARKERS)).select("path", F.lit("unsafe").alias("code"))


def kind_conflicts(annotations: DataFrame, now: float) -> DataFrame:
    """(target, severity, kinds, notes) of targets whose living notes have kinds that exclude each other."""
    kinds = annotations.where(alive(now) & F.col("target").isNotNull()).groupBy("target", "kind").agg(F.count("*").alias("n"))
    sets = kinds.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("k"))  # few kinds exist
    found = F.filter(
        F.array(*(F.when(F.map_contains_key("k", F.lit(a)) & F.map_contains_key("k", F.lit(b)), F.struct(F.lit(s).alias("severity"), F.lit(f"{a}/{b}").alias("kinds"), (F.element_at("k", F.lit(a)) + F.element_at("k", F.lit(b))).alias("notes"))) for a, b, s in KIND_CONFLICTS)),
        lambda x: x.isNotNull(),
    )
    return sets.select("target", F.explode(found).alias("x")).select("target", "x.severity", "x.kinds", "x.notes")


def deleted_targets(annotations: DataFrame, files: DataFrame, now: float) -> DataFrame:
    """(id, target, file) of living notes on files that the index no longer has."""
    notes = annotations.where(alive(now) & F.col("target").isNotNull()).select("id", "target", parse_target(F.col("target"))["file"].alias("file")).where("file is not null and file not like '%/'")
    return notes.join(files.select(F.col("path").alias("file")), "file", "left_anti").select("id", "target", "file")


def tier_contradictions(annotations: DataFrame, texts: DataFrame, now: float) -> DataFrame:
    """(id, note, code): living notes that say safe of a file with bug markers."""
    own = F.create_map(*(F.lit(x) for pair in KIND_POLARITY.items() for x in pair))[F.col("kind")]
    notes = annotations.where(alive(now)).select("id", F.coalesce(polarity(F.col("body")), own).alias("note"), parse_target(F.col("target"))["file"].alias("path")).where("note is not null")
    return notes.join(code_polarity(texts), "path").where("note <> code").select("id", "note", "code")


def ambiguous_targets(annotations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, files, severity): symbol targets whose name several files define; high from three on."""
    names = annotations.where(F.col("target").contains("#")).select("target", parse_target(F.col("target"))["name"].alias("name")).distinct()
    counts = symbols.where("name is not null and file is not null").select("name", "file").distinct().groupBy("name").agg(F.count("*").alias("files")).where("files > 1")
    return names.join(counts, "name").select("target", "files", F.when(F.col("files") >= 3, "high").otherwise("medium").alias("severity"))


def check_paths(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, reason) of indexed paths that differ from a listing (path, hash): hash-mismatch or file-missing."""
    joined = files.select("path", "hash").join(found.select("path", F.col("hash").alias("now"), F.lit(True).alias("there")), "path", "left")
    reason = F.when(F.col("there").isNull(), "file-missing").when(~F.col("hash").eqNullSafe(F.col("now")), "hash-mismatch")
    return joined.select("path", reason.alias("reason")).where("reason is not null")


def body_citations(annotations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, cited, found): identifiers in backticks (not all upper case) and paths in notes' bodies, and whether the index has them."""
    ticks = annotations.select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"`([^`\s]+)`"), F.lit(1)))).alias("cited"))
    bare = annotations.select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_][\w.-]*(?:/[\w.-]+)+\.\w+)"), F.lit(1)))).alias("cited"))
    cited = ticks.unionByName(bare).distinct()
    is_path, is_name = F.col("cited").contains("/"), F.col("cited").rlike(r"^[A-Za-z_$][\w$]*$") & ~F.col("cited").rlike(r"^[A-Z0-9_]+$")
    known = symbols.where("name is not null").select(F.col("name").alias("cited")).union(files.select("path")).distinct().withColumn("found", F.lit(True))
    return cited.where(is_path | is_name).join(known, "cited", "left").select("id", "cited", F.coalesce("found", F.lit(False)).alias("found"))


def target_status(verdicts: DataFrame) -> DataFrame:
    """(target, status) of verdicts (target, verdict): REFUTED if any is, else AMBIGUOUS if any can't be checked, else PROVED."""
    v = F.col("verdict")
    return verdicts.groupBy("target").agg(F.when(F.bool_or(v == "REFUTED"), "REFUTED").when(F.bool_or(v == "UNCHECKABLE"), "AMBIGUOUS").otherwise("PROVED").alias("status"))


def health(files: DataFrame, refs: DataFrame, edges: DataFrame, symbols: DataFrame, oversize: int = 3_000_000) -> DataFrame:
    """(check, value, level): shares of an index against thresholds; level is ok, warn or error."""
    def level(value: Column, warn: float, error: float, high_is_bad: bool = True) -> Column:
        bad, worse = (value > warn, value > error) if high_is_bad else (value < warn, value < error)
        return F.when(worse, "error").when(bad, "warn").otherwise("ok")

    def share(name: str, rows: DataFrame, hit: Column, warn: float, error: float, high_is_bad: bool = True) -> DataFrame:
        value = F.when(F.count("*") > 0, F.round(F.lit(100.0) * F.count_if(hit) / F.count("*"), 1)).otherwise(0.0)
        return rows.agg(value.alias("value")).select(F.lit(name).alias("check"), "value", level(F.col("value"), warn, error, high_is_bad).alias("level"))

    bound = binding_summary(refs, symbols).select(F.lit("ref_binding").alias("check"), F.col("internal_bound_pct").alias("value"), level(F.col("internal_bound_pct"), 80.0, 50.0, False).alias("level"))
    return (
        share("stale_files", files, F.col("stale") == 1, 5.0, 20.0)
        .unionByName(share("no_parser", files, F.coalesce("parser", F.lit("none")) == "none", 20.0, 50.0))
        .unionByName(share("oversize", files, F.col("size") > oversize, 0.0, 5.0))
        .unionByName(share("artifact_files", files, is_artifact(F.col("path")), 20.0, 50.0))
        .unionByName(share("dangling_edges", edges, F.col("dst").isNull(), 5.0, 20.0))
        .unionByName(bound)
    )
