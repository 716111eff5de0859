"""Scores, findings and small text rules over whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import binding, claims, extract, integrity
from codelode.operators import positions as S
from codelode.operators import reports as R
from codelode.queries.common import AS_OF, DAY, registry
from codelode.queries.joins import _BODIES

QUERIES, ORACLE, query = registry()
_T = "t AS (SELECT path, text FROM file_texts WHERE text IS NOT NULL)"


@query(
    f"SELECT id, CASE WHEN created_at IS NULL THEN 'never' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h ago' ELSE CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || 'd ago' END AS age FROM (SELECT id, created_at, {AS_OF} - created_at AS s FROM annotations)",
    "annotations",
)
def age_format(ix):
    return ix.once("annotations", "created_at").select("id", R.age(F.lit(AS_OF) - F.col("created_at")).alias("age"))


@query("SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(text, ':(\\d{1,9})\\b', 1), '') AS INTEGER), -1) AS line FROM documents WHERE text IS NOT NULL")
def cited_line_of_text(ix):
    return ix.raw("documents").where("text is not null").select("doc_id", F.coalesce(R.cited_line(F.col("text")), F.lit(-1)).alias("line"))


@query("SELECT DISTINCT name FROM symbols WHERE regexp_matches(name, '^[A-Za-z_$][\\w$]*$') AND NOT regexp_matches(name, '^[A-Z0-9_]+$')", "symbols")
def identifier_test(ix):
    return ix.symbols.where(R.is_identifier_citation(F.col("name"))).select("name").distinct()


@query("SELECT DISTINCT name FROM symbols WHERE length(name) BETWEEN 2 AND 40 AND regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_\\-]*$')", "symbols")
def field_name_test(ix):
    return ix.symbols.where(R.is_field_name(F.col("name"))).select("name").distinct()


@query("SELECT path, path AS clean FROM files", "files")
def normalise_paths(ix):
    """Each path with a detour put in comes back as it was."""
    detour = F.concat(F.lit("./"), F.regexp_replace("path", "^([^/]*)/", "$1/./x/../"))
    return ix.files.select("path", R.normal_path(detour).alias("clean"))


@query("SELECT id, replace(body, chr(13), chr(10)) AS body FROM annotations WHERE body IS NOT NULL AND length(body) <= 16000", "annotations")
def sanitise_bodies(ix):
    return ix.once("annotations", "target", "body").where("body is not null and length(body) <= 16000").select("id", R.clean_body(F.col("body")).alias("body"))


_SHAPE_SQL = "CASE WHEN regexp_matches(text, '(?i)[<{]\\s*(?:name|target|symbol|file|subject|query|term)\\s*[>}]') THEN 'placeholder' " + " ".join("WHEN regexp_matches(text, '(?i){}') THEN '{}'".format(p.replace("'", "''"), s) for p, s in R.SHAPES) + " ELSE 'unclassified' END"


@query(f"SELECT doc_id, {_SHAPE_SQL} AS shape FROM documents WHERE text IS NOT NULL")
def ask_shapes(ix):
    return ix.raw("documents").where("text is not null").select("doc_id", R.question_shape(F.col("text")).alias("shape"))


@query(
    "SELECT doc_id, coalesce(nullif(regexp_extract(text, '([\\w.-]+(?:/[\\w.-]+)+\\.\\w+)', 1), ''), nullif(regexp_extract(text, '`([^`]+)`', 1), ''), nullif(regexp_extract(text, '[''\"]([\\w./#-]+)[''\"]', 1), ''), nullif(regexp_extract(text, '\\b([a-z][a-z0-9]*(?:[A-Z]|_[a-z])\\w*)\\b', 1), ''), '') AS subject FROM documents WHERE text IS NOT NULL AND lang = 'en'"
)
def ask_subjects(ix):
    return ix.raw("documents").where("text is not null and lang = 'en'").select("doc_id", F.coalesce(R.question_subject(F.col("text")), F.lit("")).alias("subject"))


@query("SELECT src, dst, CASE WHEN regexp_matches(dst[8:], '^[./]') THEN 'unresolved_repo_relative' WHEN ends_with(src, '.py') AND split_part(dst[8:], '.', 1) IN ('os', 're', 'json', 'logging', 'sys') THEN 'stdlib' ELSE 'external' END AS class FROM edges WHERE starts_with(dst, 'module:') AND src IS NOT NULL", "edges")
def import_class(ix):
    rows = ix.once("edges", "src", "dst").where(F.col("dst").startswith("module:") & F.col("src").isNotNull())
    return rows.select("src", "dst", R.import_class(F.col("src"), F.expr("substring(dst, 8)"), ("os", "re", "json", "logging", "sys")).alias("class"))


@query(
    "SELECT tag, count(*) AS lines FROM (SELECT CASE WHEN regexp_matches(s, '^case\\s+[''\"]') THEN 'switch-case' WHEN regexp_matches(s, '^switch\\s*\\(') THEN 'switch-head' WHEN regexp_matches(s, '^(if[ (]|else if)') OR contains(s, '? ') THEN 'conditional' ELSE 'read' END AS tag FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS s FROM t)) GROUP BY tag",
    _T,
)
def consumer_tags(ix):
    return extract.lines(ix.texts).groupBy(R.consumer_tag(F.col("text")).alias("tag")).agg(F.count("*").alias("lines"))


@query(None)
def package_json_scan(ix):
    return R.package_entries(ix.texts)


_PY = "p AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?m)^from\\s+(\\.[\\w.]*)\\s+import\\b', 1)) AS module FROM t WHERE ends_with(path, '.py'))"


@query(
    "SELECT p.path, p.module, coalesce(a.path, b.path, '') AS dst FROM (SELECT path, module, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || replace(module[2:], '.', '/') AS stem FROM p WHERE regexp_matches(module, '^\\.\\w')) p LEFT JOIN files a ON a.path = p.stem || '.py' LEFT JOIN files b ON b.path = p.stem || '/__init__.py'",
    _T, "files", _PY,
)
def resolve_python_import(ix):
    specs = extract.matches(ix.texts.where("path like '%.py'"), r"(?m)^from\s+(\.[\w.]*)\s+import\b").select("path", F.col("name").alias("module")).where(F.col("module").rlike(r"^\.\w"))
    return R.resolve_python(specs, ix.files).withColumn("dst", F.coalesce("dst", F.lit("")))


@query("SELECT path, spec FROM (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?m)^import\\s+[^''\"\\n]*[''\"](\\./[\\w/-]+)[''\"]', 1)) AS spec FROM t WHERE ends_with(path, '.ts') OR ends_with(path, '.js')) i WHERE NOT EXISTS (SELECT 1 FROM files f WHERE starts_with(f.path, regexp_extract(i.path, '^(.*/)[^/]*$', 1) || i.spec[3:]) AND regexp_matches(f.path[length(regexp_extract(i.path, '^(.*/)[^/]*$', 1) || i.spec[3:]) + 1:], '^(\\.(js|ts|jsx|tsx|mjs|cjs|d\\.ts)|/index\\.(js|ts|jsx|tsx))?$'))", _T, "files")
def missing_paths(ix):
    specs = extract.matches(ix.texts.where("path like '%.ts' or path like '%.js'"), r"(?m)^import\s+[^'\"\n]*['\"](\./[\w/-]+)['\"]").select("path", F.col("name").alias("spec")).distinct()
    return extract.resolve_relative(specs, ix.files).where("dst is null").select("path", "spec")


@query(None)
def integrity_scores(ix):
    return R.integrity_scores(
        ix.once("annotations", "target", "kind", "body", "expires_at", "staleness", "fingerprint"), ix.symbols, ix.once("refs", "name", "file", "kind"), ix.once("edges", "src", "dst", "type", "evidence"), ix.files, ix.texts, AS_OF
    )


@query("SELECT coalesce(lang, 'other') AS lang, CASE WHEN regexp_matches(path, '(^|/)(dist|build|out|generated|__generated__|auto_generated|coverage|node_modules|vendor|third_party|third-party|tests/baselines|testRunner/fixtures|changelogs|doc/changelogs|__snapshots__)(/|$)') THEN 'artifact' WHEN regexp_matches(path, '(?i)(\\.min\\.(js|css)|\\.bundle\\.(js|css)|\\.map|_pb2\\.py|_pb2_grpc\\.py|\\.pb\\.go|\\.d\\.ts)$') THEN 'generated' WHEN regexp_matches(path, '(?i)(\\.snap|\\.baseline|\\.bak|\\.lock|\\.lockb)$') THEN 'artifact' ELSE 'source' END AS kind, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM files GROUP BY 1, 2", "files")
def repo_overview(ix):
    return R.overview(ix.files)


@query(
    f"""SELECT * FROM (SELECT 'stale_notes' AS family, 'warn' AS severity, count(*) AS findings FROM annotations WHERE staleness IN ('weakly_stale', 'strongly_stale') AND (expires_at IS NULL OR expires_at > {AS_OF})
UNION ALL SELECT 'contradicted_notes', 'error', count(*) FROM annotations WHERE staleness = 'contradicted' UNION ALL SELECT 'ambiguous_names', 'info', count(*) FROM (SELECT name FROM symbols WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1)
UNION ALL SELECT 'unused_symbols', 'info', count(*) FROM symbols WHERE name IS NULL OR name NOT IN (SELECT name FROM refs WHERE name IS NOT NULL) UNION ALL SELECT 'changed_files', 'warn', count(*) FROM files f LEFT JOIN (SELECT path, sha1(text) AS h FROM file_texts WHERE text IS NOT NULL) t ON f.path = t.path WHERE t.path IS NULL OR f.hash IS DISTINCT FROM t.h) WHERE findings > 0""",
    "annotations", "symbols", "refs", "files",
)
def report(ix):
    defs = ix.symbols.where("name is not null").groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    listing = ix.texts.where("text is not null").select("path", F.sha1(F.encode("text", "UTF-8")).alias("hash"))
    return R.findings({
        "stale_notes": ("warn", ix.once("annotations", "expires_at", "staleness", "severity").where(F.col("staleness").isin("weakly_stale", "strongly_stale") & integrity.alive(AS_OF))),
        "contradicted_notes": ("error", ix.once("annotations", "expires_at", "staleness", "severity").where("staleness = 'contradicted'")),
        "ambiguous_names": ("info", defs),
        "unused_symbols": ("info", binding.unused_symbols(ix.symbols, ix.once("refs", "name"))),
        "changed_files": ("warn", integrity.check_paths(ix.files, listing)),
    })


@query("SELECT r.file, r.line, max_by(b.names, b.line) AS name FROM (SELECT DISTINCT file, line FROM refs WHERE file IS NOT NULL AND line IS NOT NULL) r JOIN bodies b ON r.file = b.file AND b.line <= r.line GROUP BY r.file, r.line", "refs", "symbols", _BODIES)
def symbol_at_cursor(ix):
    places = ix.once("refs", "file", "name", "line").where("file is not null and line is not null").select("file", "line").distinct()
    return S.preceding(places, ix.symbols).where("name is not null").select("file", "line", "name")


@query(f"SELECT count(*) AS notes, count(*) FILTER (staleness = 'contradicted') AS refuted, count(*) FILTER (staleness IN ('weakly_stale', 'strongly_stale')) AS stale, sum(len(evidence))::BIGINT AS claims FROM annotations WHERE expires_at IS NULL OR expires_at > {AS_OF}", "annotations")
def trust_ribbon(ix):
    living = ix.once("annotations", "expires_at", "evidence", "staleness").where(integrity.alive(AS_OF))
    return living.agg(F.count("*").alias("notes"), F.count_if(F.col("staleness") == "contradicted").alias("refuted"), F.count_if(F.col("staleness").isin("weakly_stale", "strongly_stale")).alias("stale"), F.sum(F.size("evidence")).cast("long").alias("claims"))


@query(f"SELECT id, target FROM annotations WHERE staleness = 'contradicted' AND (last_verified_at IS NULL OR last_verified_at >= {AS_OF - 90 * DAY}) AND (expires_at IS NULL OR expires_at > {AS_OF})", "annotations")
def refuted_recently(ix):
    recent = F.col("last_verified_at").isNull() | (F.col("last_verified_at") >= AS_OF - 90 * DAY)
    return ix.once("annotations", "target", "expires_at", "staleness", "last_verified_at").where((F.col("staleness") == "contradicted") & recent & integrity.alive(AS_OF)).select("id", "target")


@query(None)
def fact_check(ix):
    """The verdict of each document: its claims, its citations of lines, its malformed claims."""
    docs = ix.raw("documents").where("text is not null").select("doc_id", "text")
    found = claims.extracted_claims(docs, "doc_id", "text").withColumn("claim", F.concat_ws("|", F.col("doc_id").cast("string"), "predicate", "subject", "object"))
    verdicts = found.join(claims.verify_claims(found, ix.symbols, ix.once("refs", "name", "file"), ix.once("edges", "src", "dst", "type"), ix.files), "claim").select("doc_id", "verdict")
    lines = claims.check_lines(claims.cited_lines(docs, "doc_id", "text"), ix.texts, ix.files).select("doc_id", "verdict")
    return claims.overall_verdict(verdicts.unionByName(lines), claims.malformed_claims(docs, "doc_id", "text"), "doc_id")
