"""Extraction, listings, notes and rewrites over whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions.paths import ancestors, matches_any, matches_segments
from codelode.operators import extract as E
from codelode.operators import rewrites as W
from codelode.queries.common import AS_OF, DAY, ancestors_sql, registry
from codelode.sources import listing as S
from codelode.sources import notes as N
from codelode.sources import patches as P

QUERIES, ORACLE, query = registry()
_LANG = "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANG_BY_EXTENSION.items()) + " ELSE 'other' END"
_T = "t AS (SELECT path, text FROM file_texts WHERE text IS NOT NULL)"
_SCRIPT = "(ends_with(path, '.js') OR ends_with(path, '.ts'))"


def _scripts(ix):
    return ix.texts.where("text is not null and (path like '%.js' or path like '%.ts')")


@query("SELECT path, sha1(text) AS hash FROM t", _T)
def hash_file(ix):
    return ix.texts.where("text is not null").select("path", F.sha1(F.encode("text", "UTF-8")).alias("hash"))


@query("SELECT path, len(string_split(text, chr(10))) AS lines FROM t", _T)
def read_lines(ix):
    return E.lines(ix.texts).groupBy("path").agg(F.count("*").alias("lines"))


@query(f"SELECT path, {_LANG} AS lang FROM files", "files")
def lang_of(ix):
    return ix.files.select("path", S.language(F.col("path")).alias("lang"))


@query("SELECT path, CASE WHEN regexp_matches(text, '(?m)^\\s*(class\\s+\\w+|namespace\\s+\\w*|template\\s*<|public:|private:)|\\bstd::') THEN 'cpp' ELSE 'c' END AS lang FROM t WHERE ends_with(path, '.h')", _T)
def header_language(ix):
    return ix.texts.where("text is not null and path like '%.h'").select("path", S.header_language(F.col("path"), F.col("text")).alias("lang"))


_SKIP = ", ".join(f"'{d}'" for d in S.SKIP_DIRS)


@query(
    f"SELECT path FROM files WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(path, '/')[:-2]) AS d) WHERE d IN ({_SKIP}) OR starts_with(d, '.')) AND (regexp_matches(path, '\\.py$') OR regexp_matches(path, '^brinefall/(.*/)?core/'))",
    "files",
)
def walk(ix):
    """An include of Python files and of one directory beats an exclude of the same directory."""
    return ix.files.where(S.kept(F.col("path"), ["*.py", "brinefall/core/*", "brinefall/*/core/*"], ["brinefall/core/*"])).select("path")


@query(f"SELECT path FROM files WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(path, '/')[:-2]) AS d) WHERE d IN ({_SKIP}) OR starts_with(d, '.')) AND NOT regexp_matches(path, '^brinefall/core/')", "files")
def walk_excluding(ix):
    return ix.files.where(S.kept(F.col("path"), [], ["brinefall/core/*"], exclude_wins=True)).select("path")


@query("SELECT path, size FROM files WHERE size > 5000", "files")
def oversize_skips(ix):
    return S.oversize(ix.files, 5000).select("path", "size")


RULES = "# comment\n*.css\ntools/\n!*.py\n/brinefall/src\n!keep.js\n"


@query(
    """SELECT path FROM files WHERE CASE WHEN regexp_matches(path, '(^|/)keep\\.js(/|$)') THEN false WHEN regexp_matches(path, '^brinefall/src(/|$)') THEN true WHEN regexp_matches(path, '(^|/).*\\.py(/|$)') THEN false
  WHEN regexp_matches(path, '(^|/)tools/') THEN true WHEN regexp_matches(path, '(^|/).*\\.css(/|$)') THEN true ELSE false END""",
    "files",
)
def ignore_match(ix):
    return ix.files.where(S.ignored(F.col("path"), S.parse_ignore(RULES))).select("path")


@query("SELECT * FROM (VALUES ('*.css', false, false, false), ('tools', false, true, false), ('*.py', true, false, false), ('brinefall/src', false, false, true), ('keep.js', true, false, false)) v(pattern, negate, dir_only, anchored)")
def ignore_parse(ix):
    return ix.spark.createDataFrame(S.parse_ignore(RULES), "pattern string, negate boolean, dir_only boolean, anchored boolean")


@query("SELECT path FROM files WHERE regexp_matches(path, '\\.min\\.js$') OR regexp_matches(path, '^dunmere/.*\\.go$')", "files")
def glob_match_any(ix):
    return ix.files.where(matches_any(F.col("path"), ["*.min.js", "dunmere/**/*.go"])).select("path")


@query("SELECT path FROM files WHERE regexp_matches(path, '(^|/)core/(.*/)?[^/]*\\.py$')", "files")
def skill_glob_match(ix):
    return ix.files.where(matches_segments(F.col("path"), "core/**/*.py") | F.col("path").rlike(r"(^|/)core/(.*/)?[^/]*\.py$")).select("path")


@query(f"SELECT path, name, count(*) AS calls FROM (SELECT path, unnest(regexp_extract_all(text, '(?:^|[^\\w$.])([A-Za-z_$][\\w$]{{2,}})\\s*\\(', 1)) AS name FROM t WHERE {_SCRIPT}) WHERE name NOT IN ({', '.join(repr(k) for k in E.JS_KEYWORDS)}) GROUP BY path, name", _T)
def index_regex_calls(ix):
    return E.js_calls(_scripts(ix))


@query(f"SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?m)^\\s*(?:import\\s+(?:[\\w*{{}}\\s,$]+\\s+from\\s+)?|export\\s+[\\w*{{}}\\s,$]+\\s+from\\s+)[''\"]([^''\"\\n]+)[''\"]', 1)) AS spec FROM t WHERE {_SCRIPT}", _T)
def js_imports(ix):
    return E.matches(_scripts(ix), E.JS_IMPORT).select("path", F.col("name").alias("spec")).distinct()


@query(
    """SELECT path, spec, (SELECT c.dst FROM (SELECT unnest([stem || e FOR e IN ['', '.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs', '/index.js', '/index.ts', '/index.jsx', '/index.tsx']]) AS dst, unnest(range(11)) AS r) c WHERE c.dst IN (SELECT path FROM files) ORDER BY c.r LIMIT 1) AS dst
FROM (SELECT path, spec, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || spec[3:] AS stem FROM i WHERE regexp_matches(spec, '^\\./[^.]*$'))""",
    _T, "files",
    f"i AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?m)^\\s*(?:import\\s+(?:[\\w*{{}}\\s,$]+\\s+from\\s+)?|export\\s+[\\w*{{}}\\s,$]+\\s+from\\s+)[''\"]([^''\"\\n]+)[''\"]', 1)) AS spec FROM t WHERE {_SCRIPT})",
)
def resolve_js_import(ix):
    specs = E.matches(_scripts(ix), E.JS_IMPORT).select("path", F.col("name").alias("spec")).where(F.col("spec").rlike(r"^\./[^.]*$"))
    return E.resolve_relative(specs, ix.files)


@query("SELECT DISTINCT path, unnest(regexp_extract_all(text, '[''\"]([A-Z][A-Z0-9_]{2,30})[''\"]', 1)) AS name FROM t", _T)
def scan_tokens(ix):
    return E.tokens(ix.texts)


@query(
    "SELECT path, x.n AS name, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(x.b, '[,;\\n]'), lambda m: regexp_extract(m, '^\\s*([A-Za-z_]\\w*)', 1)), lambda m: m <> ''))) AS members FROM (SELECT path, unnest(list_zip(regexp_extract_all(text, '\\benum\\s+([A-Za-z_]\\w*)\\s*\\{([^}]*)\\}', 1), regexp_extract_all(text, '\\benum\\s+([A-Za-z_]\\w*)\\s*\\{([^}]*)\\}', 2))) AS z FROM t), LATERAL (SELECT z[1] AS n, z[2] AS b) x",
    _T,
)
def scan_enum_shapes(ix):
    return E.enum_shapes(ix.texts)


@query("SELECT name, count(*) AS hits, count(DISTINCT path) AS files FROM (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) AS name FROM t) WHERE name IN (SELECT name FROM symbols) GROUP BY name", _T, "symbols")
def text_occurrences(ix):
    return E.occurrences(ix.texts, ix.symbols.where("name is not null").select("name"))


@query(
    "SELECT name, hits, coalesce(r.n, 0) AS refs FROM (SELECT name, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) AS name FROM t) WHERE name IN (SELECT name FROM symbols) GROUP BY name) LEFT JOIN (SELECT name, count(*) AS n FROM refs GROUP BY name) r USING (name) WHERE hits - coalesce(r.n, 0) >= 5 AND hits >= coalesce(r.n, 0) * 1.25",
    _T, "symbols", "refs",
)
def implicit_usage(ix):
    found = E.occurrences(ix.texts, ix.symbols.where("name is not null").select("name")).join(ix.once("refs", "name").groupBy("name").agg(F.count("*").alias("refs")), "name", "left").fillna(0, ["refs"])
    return found.where(E.implicit_usage(F.col("refs"), F.col("hits"))).select("name", "hits", "refs")


@query("SELECT path, count(*) FILTER (regexp_matches(line, '^\\s*(#|//|/\\*|\\*|--)')) AS comments FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM t) GROUP BY path", _T)
def comment_only_lines(ix):
    return E.lines(ix.texts).groupBy("path").agg(F.count_if(E.comment_only(F.col("text"))).alias("comments"))


@query(
    "SELECT path, CASE WHEN regexp_matches(path, '(^|/)(__main__\\.py|main\\.(py|go|c|js|ts)|cli\\.py|index\\.(js|ts))$') THEN 'name' ELSE 'guard' END AS kind FROM t WHERE regexp_matches(path, '(^|/)(__main__\\.py|main\\.(py|go|c|js|ts)|cli\\.py|index\\.(js|ts))$') "
    "OR regexp_matches(text, '(?m)^if\\s+__name__\\s*==\\s*[''\"]__main__[''\"]') OR regexp_matches(text, '(?m)^func\\s+main\\s*\\(\\s*\\)') OR regexp_matches(text, 'public\\s+static\\s+void\\s+main\\s*\\(')",
    _T,
)
def entrypoints(ix):
    return E.entrypoints(ix.texts)


@query("SELECT dst, CASE WHEN regexp_matches(dst[8:], '^<.*>$|\\.h(pp)?$') THEN 'external_include' WHEN starts_with(dst[8:], '.') THEN 'repo_relative' WHEN starts_with(dst[8:], '/') THEN 'root_import' ELSE 'module' END AS kind, count(*) AS edges FROM edges WHERE starts_with(dst, 'module:') GROUP BY 1, 2", "edges")
def unresolved_imports(ix):
    return ix.once("edges", "dst").where(F.col("dst").startswith("module:")).groupBy("dst", E.unresolved_kind(F.col("dst")).alias("kind")).agg(F.count("*").alias("edges"))


@query(None)
def index_python(ix):
    """Symbols, references and imports from the syntax trees of all Python files."""
    return E.index_python(ix.texts.where("path like '%.py'"))


@query(None)
def scan_contracts(ix):
    return E.contracts(ix.texts)


@query(
    "SELECT sha1(coalesce(target, '') || '|' || coalesce(kind, '') || '|' || coalesce(body, '')) AS hash, count(*) AS notes FROM annotations GROUP BY 1", "annotations",
)
def note_hashes(ix):
    return ix.once("annotations", "target", "kind", "body").groupBy(N.note_hash(F.col("target"), F.col("kind"), F.col("body")).alias("hash")).agg(F.count("*").alias("notes"))


@query(
    "SELECT DISTINCT target, kind, body FROM annotations a WHERE author IS NULL AND NOT EXISTS (SELECT 1 FROM annotations b WHERE b.author IS NOT NULL AND coalesce(a.target, '') = coalesce(b.target, '') AND coalesce(a.kind, '') = coalesce(b.kind, '') AND coalesce(a.body, '') = coalesce(b.body, ''))",
    "annotations",
)
def note_import(ix):
    """Notes with an author as existing, those without as incoming."""
    return N.new_notes(ix.once("annotations", "target", "kind", "body", "author").where("author is null").select("target", "kind", "body"), ix.once("annotations", "target", "kind", "body", "author").where("author is not null")).select("target", "kind", "body")


@query(None)
def note_export(ix):
    return N.exported(ix.raw("annotations").distinct())


@query(
    "SELECT target, CASE WHEN target IS NULL OR target = '' THEN 'missing_target' WHEN target IN (SELECT path FROM files UNION SELECT name FROM symbols WHERE name IS NOT NULL UNION SELECT symbol_id FROM symbols WHERE symbol_id IS NOT NULL) THEN 'ok' ELSE 'invalid_target' END AS state, count(*) AS \"rows\" FROM annotations GROUP BY 1, 2",
    "annotations", "files", "symbols",
)
def evidence_ingest(ix):
    """The targets of all notes, written as JSON lines and read again as evidence."""
    lines = ix.once("annotations", "target", "kind", "body", "confidence", "evidence").select(F.to_json(F.struct("target", "kind", F.col("body").alias("note"))).alias("value"))
    return N.read_evidence(lines, ix.files, ix.symbols).groupBy("target", "state").agg(F.count("*").alias("rows"))


_MERGED = "m AS (SELECT id, src, dst, type FROM edges WHERE confidence IS NOT NULL UNION ALL SELECT id, src, dst, 'checked' FROM edges WHERE confidence IS NULL)"


@query("SELECT id, src, dst, type FROM m", "edges", _MERGED)
def upsert_rows(ix):
    checked = ix.once("edges", "src", "dst", "type", "confidence").where("confidence is null").select("id", "src", "dst", F.lit("checked").alias("type"))
    return W.upsert(ix.once("edges", "src", "dst", "type", "confidence").select("id", "src", "dst", "type"), checked, ("id",))


@query("SELECT id, file FROM refs WHERE file IS NULL OR file NOT IN (SELECT path FROM files WHERE stale = 1)", "refs", "files")
def remove_files(ix):
    return W.without_files(ix.once("refs", "file"), "file", ix.files.where("stale = 1")).select("id", "file")


@query("SELECT src, dst, type, min(id) AS id FROM edges e WHERE type = 'imports' AND src IS NOT NULL AND dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.type = 'pair_inspect' AND x.src = e.src AND x.dst = e.dst) GROUP BY 1, 2, 3", "edges")
def add_edges_once(ix):
    rows = ix.once("edges", "src", "dst", "type").where("src is not null and dst is not null")
    other = rows.where("type = 'pair_inspect'").withColumn("type", F.lit("imports"))
    return W.add_once(other, rows.where("type = 'imports'").select("src", "dst", "type", "id"), ("src", "dst", "type"))


@query(
    f"""SELECT a.id, CASE WHEN (a.expires_at IS NULL OR a.expires_at > {AS_OF}) AND (coalesce(a.created_at < {AS_OF - 200 * DAY}, false) OR (contains(a.target, '/') AND NOT ends_with(a.target, '/') AND split_part(a.target, '#', 1) NOT IN (SELECT path FROM files))) THEN {AS_OF} ELSE a.expires_at END AS expires_at FROM annotations a""",
    "annotations", "files",
)
def expire_notes(ix):
    return W.expire(ix.once("annotations", "target", "created_at", "expires_at"), ix.files, AS_OF, 200 * DAY).select("id", "expires_at")


@query("SELECT a.id, CASE WHEN l.n IS NOT NULL THEN 'moved/' || a.target ELSE a.target END AS target FROM annotations a LEFT JOIN (SELECT DISTINCT current_path AS n FROM file_lifeline WHERE tombstoned_at IS NOT NULL) l ON split_part(a.target, '#', 1) = l.n", "annotations")
def retarget_notes(ix):
    moved = ix.lifelines.where("tombstoned_at is not null and current_path is not null").select(F.col("current_path").alias("old"), F.concat(F.lit("moved/"), "current_path").alias("new")).distinct()
    return W.retarget(ix.once("annotations", "target"), moved).select("id", "target")


@query("SELECT path AS current_path FROM files WHERE path NOT IN (SELECT current_path FROM file_lifeline WHERE tombstoned_at IS NULL AND current_path IS NOT NULL)", "files")
def ensure_lifelines(ix):
    return W.missing_lifelines(ix.files, ix.lifelines).select("current_path")


@query("SELECT lifeline_id, first(kind ORDER BY \"at\" DESC NULLS LAST, id DESC NULLS LAST) AS kind, max(\"at\") AS \"at\" FROM events WHERE lifeline_id IS NOT NULL GROUP BY lifeline_id", "events")
def latest_event(ix):
    return W.latest_version(ix.events.where("lifeline_id is not null").select("lifeline_id", "at", "id", "kind"), ("lifeline_id",), "at").select("lifeline_id", "kind", "at")


@query(f"SELECT id, coalesce(expires_at, opened_at + 300) AS due FROM leases WHERE state = 'open' AND coalesce(expires_at, opened_at + 300) <= {AS_OF}", "leases")
def lease_expiry(ix):
    return W.overdue(ix.leases, AS_OF)


_CLASS = """SELECT file, line, CASE WHEN hit THEN 'at_risk' WHEN shift <> 0 THEN 'moved' ELSE 'unaffected' END AS status, CASE WHEN NOT hit AND shift <> 0 THEN line + shift ELSE -1 END AS new_line FROM (
  SELECT r.file, r.line, coalesce(bool_or(h.c > 0 AND r.line BETWEEN h.s AND h.s + h.c - 1), false) AS hit, coalesce(sum(CASE WHEN CASE WHEN h.c = 0 THEN r.line >= h.s ELSE r.line > h.s + h.c - 1 END THEN h.n - h.c END), 0)::BIGINT AS shift
  FROM (SELECT DISTINCT file, line FROM refs WHERE file IS NOT NULL AND line IS NOT NULL) r LEFT JOIN (VALUES (10, 3, 5), (40, 0, 7), (60, 4, 1)) h(s, c, n) ON r.file = 'brinefall/core/runtime/dispatch.py' GROUP BY r.file, r.line)"""


@query(_CLASS, "refs")
def classify_cited_lines(ix):
    patch = "--- a/brinefall/core/runtime/dispatch.py\n+++ b/brinefall/core/runtime/dispatch.py\n@@ -10,3 +10,5 @@\n a\n@@ -40,0 +42,7 @@\n+b\n@@ -60,4 +69 @@\n-c\n"
    hunks = P.parse_patches(ix.spark.createDataFrame([(1, patch)], "id int, patch string"), "id", "patch")
    lines = ix.once("refs", "file", "line").where("file is not null and line is not null").select("file", "line")
    return P.classify_lines(lines, hunks).select("file", "line", "status", F.coalesce("new_line", F.lit(-1)).cast("long").alias("new_line"))


@query(f"SELECT dir, count(*) FILTER (n = 0) AS bare FROM (SELECT d.dir, d.path, count(a.id) AS n FROM (SELECT path, unnest({ancestors_sql('path')}) AS dir FROM files) d LEFT JOIN annotations a ON a.target = d.path GROUP BY d.dir, d.path) GROUP BY dir", "files", "annotations")
def bare_files_per_directory(ix):
    noted = ix.files.select("path").join(ix.once("annotations", "target").select(F.col("target").alias("path")).distinct().withColumn("n", F.lit(1)), "path", "left")
    return noted.select(F.explode(ancestors(F.col("path"))).alias("dir"), "n").groupBy("dir").agg(F.count_if(F.col("n").isNull()).alias("bare"))
