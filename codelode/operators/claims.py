"""Claims: extraction from texts, and verdicts against the current index.

A verdict is an equi join of claims with what the index holds, reduced to flags per claim; which flag
decides is a fixed order. Names with many definitions are combined to sets before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.paths import suffixes

# Patterns and labels that results must equal.
INLINE = r"(?i)@([a-z][a-z0-9_\-]{1,40})\(([^)]{1,400})\)"
EXTENSIONS = "ts|tsx|js|jsx|mjs|cjs|py|go|rs|c|cc|cpp|cxx|h|hpp|java|rb|kt|swift|php|scala"
DEFINED_AT = r"(?i)`([A-Za-z_$][\w$]{1,80})`\s+(?:is\s+)?(?:defined|declared|implemented)\s+(?:at|in)\s+([\w./\-]+\.(?:" + EXTENSIONS + r")):(\d+)"
EXPORTED_FROM = r"(?i)`([A-Za-z_$][\w$]{1,80})`\s+(?:is\s+)?(?:exported\s+from|lives\s+in|defined\s+in)\s+([\w./\-]+\.(?:" + EXTENSIONS + r"))\b(?!:\d)"
FILE_LINE = r"\b([\w./\-]+\.(?:" + EXTENSIONS + r")):(\d+)\b"
OPENING = r"(?i)@([a-z][a-z0-9_\-]{1,40})\(([^)\n]*)(\)?)"
VERIFIED, MOVED, REFUTED, UNCHECKABLE = "VERIFIED", "MOVED", "REFUTED", "UNCHECKABLE"
# End of fixed values.


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[`'\"]+|[`'\"]+$", "")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All matches of a pattern as structs (g1, ..., gn)."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)))


def inline_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, predicate, subject, object) of `@predicate(subject, object)`: the first comma divides, quotes are dropped, repeats come once."""
    found = texts.select(key, F.explode(_groups(F.col(text), INLINE, 2)).alias("x")).where(F.col("x.g2").contains(","))
    halves = found.select(key, F.lower("x.g1").alias("predicate"), _trim(F.substring_index("x.g2", ",", 1)).alias("subject"), _trim(F.regexp_extract("x.g2", r"(?s)^[^,]*,(.*)$", 1)).alias("object"))
    return halves.where("subject <> '' and object <> ''").distinct()


def sentence_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, predicate, subject, object) of sentences such as "`f` is defined at a.py:3" and "`f` is exported from a.py"."""
    at = texts.select(key, F.explode(_groups(F.col(text), DEFINED_AT, 3)).alias("x")).select(key, F.lit("defined-at").alias("predicate"), F.col("x.g1").alias("subject"), F.concat_ws(":", "x.g2", "x.g3").alias("object"))
    out = texts.select(key, F.explode(_groups(F.col(text), EXPORTED_FROM, 2)).alias("x")).select(key, F.lit("exported-from").alias("predicate"), F.col("x.g1").alias("subject"), F.col("x.g2").alias("object"))
    return at.unionByName(out).distinct()


def extracted_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    return inline_claims(texts, key, text).unionByName(sentence_claims(texts, key, text)).distinct()


def cited_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, line): distinct mentions `path:line` of source files."""
    found = texts.select(key, F.explode(_groups(F.col(text), FILE_LINE, 2)).alias("x"))
    return found.select(key, F.col("x.g1").alias("path"), F.expr("try_cast(x.g2 as int)").alias("line")).distinct()


def malformed_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, predicate, reason): openings of claims that lack their bracket (`unclosed`) or their comma (`no_comma`)."""
    found = texts.select(key, F.explode(_groups(F.col(text), OPENING, 3)).alias("x"))
    reason = F.when(F.col("x.g3") != ")", "unclosed").when(~F.col("x.g2").contains(","), "no_comma")
    return found.select(key, F.lower("x.g1").alias("predicate"), reason.alias("reason")).where("reason is not null").distinct()


def location(place: str) -> Column:
    """struct(file, line) of a column with `file:line`; a place without a number at its end is a file with a null line."""
    whole = F.col(place).rlike(r"(?s)^.+:\d+$")
    line = F.expr(f"try_cast(regexp_extract(`{place}`, ':(\\\\d+)$', 1) as int)")
    return F.struct(F.when(whole, F.regexp_extract(place, r"(?s)^(.*):\d+$", 1)).otherwise(F.col(place)).alias("file"), F.when(whole, line).alias("line"))


def resolved(places: DataFrame, files: DataFrame) -> DataFrame:
    """(file, path, matches) for distinct cited files: the indexed path itself, else the only one that ends in it."""
    asked = places.where("file is not null").select("file").distinct()
    exact = files.select(F.col("path").alias("file"), F.lit(True).alias("exact"))
    ends = files.select("path", F.explode(F.slice(suffixes(F.col("path")), 2, 1 << 20)).alias("file")).join(asked, "file", "left_semi")
    counted = ends.groupBy("file").agg(F.count("*").alias("n"), F.min("path").alias("only"))
    joined = asked.join(exact, "file", "left").join(counted, "file", "left")
    path = F.when(F.col("exact"), F.col("file")).when(F.col("n") == 1, F.col("only"))
    return joined.select("file", path.alias("path"), F.when(F.col("exact"), 1).otherwise(F.coalesce("n", F.lit(0))).alias("matches"))


def verify_defined_at(claims: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """claims (claim, subject, object) with a verdict.

    VERIFIED at the very file and line; MOVED in the file on another line; UNCHECKABLE without a line
    or if the cited file fits several; else REFUTED.
    """
    parts = claims.withColumn("place", location("object")).select("claim", "subject", "object", F.when(F.col("place.line").isNotNull(), F.col("place.file")).alias("file"), F.col("place.line").alias("line"))
    placed = parts.join(resolved(parts, files), "file", "left")
    defs = symbols.where("name is not null").groupBy(F.col("name").alias("subject"), F.col("file").alias("path")).agg(F.collect_set("line").alias("lines"))  # lines of a name in a file
    joined = placed.join(defs, ["subject", "path"], "left")
    verdict = (
        F.when(F.col("line").isNull() | (F.col("matches") > 1), UNCHECKABLE)
        .when(F.coalesce(F.array_contains("lines", F.col("line")), F.lit(False)), VERIFIED)
        .when(F.col("lines").isNotNull(), MOVED)
        .otherwise(REFUTED)
    )
    return joined.select("claim", "subject", "object", verdict.alias("verdict"))


def verify_in_file(claims: DataFrame, symbols: DataFrame, files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """claims (claim, subject, object = file) with a verdict: VERIFIED if the file defines the name, or has it as an enum member (file, name)."""
    placed = claims.withColumn("file", F.col("object")).join(resolved(claims.select(F.col("object").alias("file")), files), "file", "left")
    names = symbols.select(F.col("name").alias("subject"), F.col("file").alias("path"))
    if members is not None:
        names = names.unionByName(members.select(F.col("name").alias("subject"), F.col("file").alias("path")))
    joined = placed.join(names.where("subject is not null").distinct().withColumn("there", F.lit(True)), ["subject", "path"], "left")
    verdict = F.when(F.col("object").isNull() | (F.col("matches") > 1), UNCHECKABLE).when(F.col("there"), VERIFIED).otherwise(REFUTED)
    return joined.select("claim", "subject", "object", verdict.alias("verdict"))


def verify_called_by(claims: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """claims (claim, subject, object = file) with a verdict: VERIFIED if the file refers to the name."""
    placed = claims.withColumn("file", F.col("object")).join(resolved(claims.select(F.col("object").alias("file")), files), "file", "left")
    uses = refs.where("name is not null and file is not null").select(F.col("name").alias("subject"), F.col("file").alias("path")).distinct().withColumn("there", F.lit(True))
    joined = placed.join(uses, ["subject", "path"], "left")
    verdict = F.when(F.col("object").isNull() | (F.col("matches") > 1), UNCHECKABLE).when(F.col("there"), VERIFIED).otherwise(REFUTED)
    return joined.select("claim", "subject", "object", verdict.alias("verdict"))


def verify_edge(claims: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """claims (claim, subject = leaf, object = origin) with a verdict: VERIFIED if an edge of the kind leads from object to subject.

    For imports the verdict is UNCHECKABLE where the origin has export-star edges, as those may carry it.
    """
    there = edges.where(F.col("type") == kind).select(F.col("src").alias("object"), F.col("dst").alias("subject")).distinct().withColumn("there", F.lit(True))
    barrels = edges.where("type = 'reexport_star' and src is not null").select(F.col("src").alias("object")).distinct().withColumn("barrel", F.lit(True))
    joined = claims.join(there, ["object", "subject"], "left").join(barrels, "object", "left")
    verdict = F.when(F.col("subject").isNull() | F.col("object").isNull(), UNCHECKABLE).when(F.col("there"), VERIFIED)
    if kind == "imports":
        verdict = verdict.when(F.col("barrel"), UNCHECKABLE)
    return joined.select("claim", "subject", "object", verdict.otherwise(REFUTED).alias("verdict"))


def note_claims(annotations: DataFrame) -> DataFrame:
    """(id, claim, subject, predicate, object, truth_class, confidence): the claims of notes' evidence, numbered; those without a predicate are none."""
    rows = annotations.select("id", F.posexplode("evidence").alias("pos", "e"))
    out = rows.select("id", F.concat_ws("/", F.col("id").cast("string"), F.col("pos").cast("string")).alias("claim"), "e.subject", "e.predicate", "e.object", F.coalesce("e.truth_class", F.lit("INFERENCE")).alias("truth_class"), F.coalesce("e.confidence", F.lit(0.7)).alias("confidence"))
    return out.where("predicate is not null and predicate <> ''")


def verify_claims(claims: DataFrame, symbols: DataFrame, refs: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(claim, verdict) by predicate; unknown predicates are UNCHECKABLE."""
    of = lambda *names: claims.where(F.col("predicate").isin(*names)).select("claim", "subject", "object")
    known = ("defined-at", "exported-from", "exists", "defined_at", "called_by", "reexported-via", "reverse-dependency-of")
    parts = [
        verify_defined_at(of("defined-at"), symbols, files),
        verify_in_file(of("exported-from", "exists", "defined_at"), symbols, files),
        verify_called_by(of("called_by"), refs, files),
        verify_edge(of("reexported-via"), edges, "reexport_star"),
        verify_edge(of("reverse-dependency-of"), edges, "imports"),
        claims.where(~F.col("predicate").isin(*known)).select("claim", "subject", "object", F.lit(UNCHECKABLE).alias("verdict")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("claim", "verdict")


def note_status(verdicts: DataFrame) -> DataFrame:
    """(id, status, confidence, verified, refuted, uncheckable) per note of verdicts (id, verdict, truth_class, confidence)."""
    v = F.col("verdict")
    sums = verdicts.groupBy("id").agg(
        F.count_if(v == VERIFIED).alias("verified"), F.count_if(v == REFUTED).alias("refuted"), F.count_if(v == UNCHECKABLE).alias("uncheckable"), F.count_if(v == MOVED).alias("moved"), F.count("*").alias("n"),
        F.count_if((v == REFUTED) & (F.col("truth_class") == "FACT")).alias("facts"),
        F.sum("confidence").alias("weight"), F.sum(F.col("confidence") * F.when(v == VERIFIED, 1.0).when(v == UNCHECKABLE, 0.5).otherwise(0.0)).alias("score"),
    )
    status = (
        F.when(F.col("facts") > 0, "contradicted").when(F.col("refuted") > 0, "strongly_stale").when(F.col("moved") > 0, "weakly_stale")
        .when(F.col("verified") == F.col("n"), "fresh").when(F.col("uncheckable") == F.col("n"), "unknown").otherwise("weakly_stale")
    )
    return sums.select("id", status.alias("status"), F.when(F.col("weight") > 0, F.round(F.col("score") / F.col("weight"), 4)).alias("confidence"), "verified", "refuted", "uncheckable")


def check_lines(cited: DataFrame, texts: DataFrame, files: DataFrame) -> DataFrame:
    """(key..., path, line, verdict) of cited places: VERIFIED within a file, REFUTED beyond its end or without a file, UNCHECKABLE if several files fit."""
    lines = texts.where("text is not null").select("path", (F.regexp_count("text", F.lit("\n")) + F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 0).otherwise(1)).alias("lines"))
    found = resolved(cited.select(F.col("path").alias("file")), files).withColumnRenamed("path", "full")
    joined = cited.withColumnRenamed("path", "file").join(found, "file", "left").join(lines.withColumnRenamed("path", "full"), "full", "left")
    verdict = F.when(F.col("matches") > 1, UNCHECKABLE).when(F.col("lines").isNull() | (F.col("line") > F.col("lines")) | (F.col("line") < 1), REFUTED).otherwise(VERIFIED)
    return joined.withColumn("verdict", verdict).drop("full", "matches", "lines").withColumnRenamed("file", "path")


def triple_hash(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.sha1(F.concat_ws("|", subject, predicate, obj))


def uncaptured(claims: DataFrame, captured: DataFrame) -> DataFrame:
    """Claims (subject, predicate, object) whose triple no captured claim has."""
    key = triple_hash(F.col("subject"), F.col("predicate"), F.col("object"))
    return claims.withColumn("triple", key).join(captured.select(key.alias("triple")).distinct(), "triple", "left_anti")


def overall_verdict(verdicts: DataFrame, malformed: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of texts: parse_errors, else refuted, moved, uncheckable or verified, whichever comes first."""
    v = F.col("verdict")
    sums = verdicts.groupBy(key).agg(F.count_if(v == REFUTED).alias("r"), F.count_if(v == MOVED).alias("m"), F.count_if(v == UNCHECKABLE).alias("u"))
    joined = sums.join(malformed.groupBy(key).agg(F.count("*").alias("bad")), key, "full")
    verdict = F.when(F.col("bad") > 0, "parse_errors").when(F.col("r") > 0, "refuted").when(F.col("m") > 0, "moved").when(F.col("u") > 0, "uncheckable").otherwise("verified")
    return joined.select(key, verdict.alias("verdict"))
