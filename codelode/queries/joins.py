"""Anti, semi and range joins and binding over whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions.paths import ancestors
from codelode.operators import binding as B
from codelode.operators import positions as S
from codelode.operators.lookups import alive
from codelode.queries.common import AS_OF, DAY, ancestors_sql, registry

HUB = "dunmere/pkg/base/base.go"
QUERIES, ORACLE, query = registry()
_NAMES = "n AS (SELECT DISTINCT name FROM refs WHERE name IS NOT NULL)"
_EVIDENCE = "t AS (SELECT DISTINCT unnest([e.subject, e.object]) AS target FROM (SELECT unnest(evidence) AS e FROM annotations))"


def _evidence(ix):
    e = ix.once("annotations", "target", "evidence").select(F.explode("evidence").alias("e"))
    return e.select(F.explode(F.array("e.subject", "e.object")).alias("target"))


@query("SELECT file, name, kind, line FROM symbols WHERE name NOT IN (SELECT name FROM n) AND kind IN ('function', 'class', 'method')", "symbols", "refs", _NAMES)
def orphan_symbols(ix):
    return B.unused_symbols(ix.symbols, ix.once("refs", "file", "name", "kind", "line"), ("function", "class", "method")).select("file", "name", "kind", "line")


@query(
    "SELECT r.name, f.lang, count(*) AS refs FROM refs r LEFT JOIN files f ON r.file = f.path WHERE r.name IS NOT NULL AND r.name NOT IN (SELECT name FROM symbols WHERE name IS NOT NULL) GROUP BY r.name, f.lang",
    "refs", "symbols", "files",
)
def parity_refs_without_defs(ix):
    return B.undefined_references(ix.once("refs", "file", "name"), ix.symbols, ix.files)


@query("SELECT DISTINCT name FROM symbols WHERE name NOT IN (SELECT name FROM n)", "symbols", "refs", _NAMES)
def parity_defs_without_refs(ix):
    return B.unused_symbols(ix.symbols, ix.once("refs", "name")).select("name").distinct()


@query(
    "SELECT r.name, f.lang, count(*) AS refs FROM refs r JOIN files f ON r.file = f.path WHERE r.name NOT IN (SELECT name FROM symbols WHERE name IS NOT NULL) AND NOT (f.lang = 'python' AND r.name IN ('assertEqual', 'print')) GROUP BY r.name, f.lang HAVING f.lang IS NOT NULL",
    "refs", "symbols", "files",
)
def builtin_filter(ix):
    builtins = ix.spark.createDataFrame([("python", "assertEqual"), ("python", "print")], "lang string, name string")
    return B.undefined_references(ix.once("refs", "file", "name"), ix.symbols, ix.files, F.broadcast(builtins)).where("lang is not null")


@query("SELECT file, name, kind FROM symbols WHERE name NOT IN (SELECT name FROM n) AND NOT regexp_matches(file, '(^|/)(dist|build|out|generated|vendor|third_party|node_modules)(/|$)')", "symbols", "refs", _NAMES)
def isolated_symbols(ix):
    found = B.unused_symbols(ix.symbols, ix.once("refs", "file", "name", "kind"))
    return found.where(~F.col("file").rlike("(^|/)(dist|build|out|generated|vendor|third_party|node_modules)(/|$)")).select("file", "name", "kind")


@query("SELECT file, name, line FROM symbols WHERE name NOT IN (SELECT target FROM t WHERE target IS NOT NULL) AND file NOT IN (SELECT target FROM t WHERE target IS NOT NULL)", "symbols", "annotations", _EVIDENCE)
def drift(ix):
    return B.untouched_symbols(ix.symbols, _evidence(ix)).select("file", "name", "line")


@query("SELECT id FROM refs WHERE name IN (SELECT name FROM symbols)", "refs", "symbols")
def internal_bindable(ix):
    return B.bindable(ix.once("refs", "file", "name", "line", "target_symbol_id"), ix.symbols).select("id")


_BIND = (
    "defs AS (SELECT file, name, line, symbol_id FROM symbols WHERE symbol_id IS NOT NULL AND name IS NOT NULL)",
    "imp AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'imports' AND src IS NOT NULL AND dst IS NOT NULL)",
    "star AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'reexport_star' AND src IS NOT NULL AND dst IS NOT NULL)",
    "h2 AS (SELECT src, dst FROM star UNION SELECT a.src, b.dst FROM star a JOIN star b ON a.dst = b.src)",
    "h4 AS (SELECT src, dst FROM h2 UNION SELECT a.src, b.dst FROM h2 a JOIN h2 b ON a.dst = b.src)",
    "far AS (SELECT DISTINCT i.src, h.dst FROM imp i JOIN h4 h ON i.dst = h.src)",
    "own AS (SELECT file, name, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY line, symbol_id) AS rn FROM defs) WHERE rn = 1)",
    "t2 AS (SELECT i.src AS file, d.name, min(d.symbol_id) AS s FROM imp i JOIN defs d ON i.dst = d.file GROUP BY 1, 2 HAVING count(*) = 1)",
    "t3 AS (SELECT i.src AS file, d.name, min(d.symbol_id) AS s FROM far i JOIN defs d ON i.dst = d.file GROUP BY 1, 2 HAVING count(*) = 1)",
    "t4 AS (SELECT name, min(symbol_id) AS s, count(*) AS n FROM defs GROUP BY name)",
    """bound AS (SELECT r.id, coalesce(r.target_symbol_id, own.symbol_id, t2.s, t3.s, CASE WHEN t4.n = 1 THEN t4.s END) AS target_symbol_id,
  CASE WHEN r.target_symbol_id IS NOT NULL THEN 'already_bound' WHEN own.symbol_id IS NOT NULL THEN 'same_file' WHEN t2.s IS NOT NULL THEN 'imported' WHEN t3.s IS NOT NULL THEN 'reexport'
       WHEN t4.n = 1 THEN 'global_unique' WHEN t4.n > 1 THEN 'ambiguous' ELSE 'no_match' END AS tier
  FROM refs r LEFT JOIN own ON r.file = own.file AND r.name = own.name LEFT JOIN t2 ON r.file = t2.file AND r.name = t2.name
  LEFT JOIN t3 ON r.file = t3.file AND r.name = t3.name LEFT JOIN t4 ON r.name = t4.name)""",
)


@query("SELECT id, target_symbol_id, tier FROM bound", "refs", "symbols", "edges", *_BIND)
def resolve_refs(ix):
    return B.resolve_refs(ix.once("refs", "file", "name", "line", "target_symbol_id"), ix.symbols, ix.once("edges", "src", "dst", "type"))


@query("SELECT tier, count(*) AS refs FROM bound GROUP BY tier", "refs", "symbols", "edges", *_BIND)
def resolve_refs_counts(ix):
    return B.resolve_refs(ix.once("refs", "file", "name", "line", "target_symbol_id"), ix.symbols, ix.once("edges", "src", "dst", "type")).groupBy("tier").agg(F.count("*").alias("refs"))


@query("SELECT src, dst FROM h4", "edges", *_BIND[2:5])
def reexport_closure(ix):
    return B.closure(ix.once("edges", "src", "dst", "type").where("type = 'reexport_star'"), 4).select("src", "dst")


@query(
    """SELECT t AS total_refs, b AS bound_refs, t - b AS unbound_refs, round(100.0 * b / t, 1)::DOUBLE AS bound_pct, i AS internal_bindable, t - i AS external_refs, round(100.0 * b / i, 1)::DOUBLE AS internal_bound_pct
FROM (SELECT count(*) AS t, count(target_symbol_id) AS b, count(*) FILTER (name IN (SELECT name FROM symbols WHERE name IS NOT NULL)) AS i FROM refs)""",
    "refs", "symbols",
)
def binding_summary(ix):
    return B.binding_summary(ix.once("refs", "name", "target_symbol_id"), ix.symbols)


@query(
    f"""SELECT name, kind, file FROM (SELECT DISTINCT name, kind, file FROM symbols) p WHERE file <> '{HUB}' AND (name, kind) IN
  (SELECT (name, kind) FROM (SELECT DISTINCT name, kind, file FROM symbols) GROUP BY name, kind HAVING count(file) <= 6 AND bool_or(file = '{HUB}'))""",
    "symbols",
)
def shared_peers(ix):
    return B.peers(ix.symbols, ("name", "kind"), "file", HUB)


@query(
    """SELECT coalesce(a.name, b.name) AS name, coalesce(a.n, 0) AS calls, coalesce(b.n, 0) AS imports, CASE WHEN b.n IS NULL THEN 'calls_only' WHEN a.n IS NULL THEN 'imports_only' ELSE 'both' END AS status
FROM (SELECT name, count(*) AS n FROM refs WHERE kind = 'call' AND name IS NOT NULL GROUP BY name) a FULL JOIN (SELECT name, count(*) AS n FROM refs WHERE kind = 'import' AND name IS NOT NULL GROUP BY name) b ON a.name = b.name""",
    "refs",
)
def cross_layer_join(ix):
    return B.two_sided(ix.once("refs", "name", "kind").where("kind = 'call'"), ix.once("refs", "name", "kind").where("kind = 'import'"), "name", ("calls", "imports"))


_CITED = "c AS (SELECT DISTINCT array_to_string(list_slice(string_split(e.object, '/'), -2, -1), '/') AS cited FROM (SELECT unnest(evidence) AS e FROM annotations) WHERE e.object IS NOT NULL)"


@query("SELECT c.cited, CASE WHEN count(f.path) = 1 THEN min(f.path) END AS path, count(f.path) AS matches FROM c LEFT JOIN files f ON f.path = c.cited OR ends_with(f.path, '/' || c.cited) GROUP BY c.cited", "annotations", "files", _CITED)
def citation_match(ix):
    objects = ix.once("annotations", "evidence").select(F.explode("evidence").alias("e")).select(F.split("e.object", "/").alias("p")).where("p is not null")
    cited = objects.select(F.array_join(F.slice("p", F.greatest(F.size("p") - 1, F.lit(1)), 2), "/").alias("cited"))
    return B.cited_paths(cited, ix.files)


@query("SELECT e.src, e.dst, f.parser FROM edges e LEFT JOIN files f ON e.src = f.path WHERE e.type = 'imports'", "edges", "files")
def consumer_parser_join(ix):
    return ix.once("edges", "src", "dst", "type").where("type = 'imports'").join(ix.files.select(F.col("path").alias("src"), "parser"), "src", "left").select("src", "dst", "parser")


@query(f'SELECT e.id, e.kind, e."at", l.current_path FROM events e JOIN file_lifeline l ON e.lifeline_id = l.id WHERE e.id > 0', "events")
def file_event_tail(ix):
    return ix.events.where("id > 0").join(ix.lifelines.select(F.col("id").alias("lifeline_id"), "current_path"), "lifeline_id").select("id", "kind", "at", "current_path")


_BODIES = "bodies AS (SELECT file, line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line) - 1, line + 200) AS end_line, names FROM (SELECT file, line, min(name) AS names FROM symbols WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY file, line))"


@query("SELECT r.id, b.names AS name, b.line AS def_line FROM refs r JOIN bodies b ON r.file = b.file AND r.line BETWEEN b.line AND b.end_line", "refs", "symbols", _BODIES)
def enclosing_scope(ix):
    return S.enclosing(ix.once("refs", "file", "name", "line"), ix.symbols).where("name is not null").select("id", "name", "def_line")


@query("SELECT r.id, r.line, max_by(b.names, b.line) AS name FROM refs r LEFT JOIN bodies b ON r.file = b.file AND b.line <= r.line GROUP BY r.id, r.line", "refs", "symbols", _BODIES)
def enclosing_symbol(ix):
    return S.preceding(ix.once("refs", "file", "name", "line"), ix.symbols).select("id", "line", "name")


@query("SELECT file, line, end_line, names AS name FROM bodies", "symbols", _BODIES)
def heuristic_body_end(ix):
    return S.bodies(ix.symbols)


_CALLS = "calls AS (SELECT DISTINCT b.file AS caller_file, b.names AS caller, r.name AS callee FROM refs r JOIN bodies b ON r.file = b.file AND r.line BETWEEN b.line AND b.end_line WHERE r.kind = 'call' AND r.name IS NOT NULL)"


@query(
    "SELECT c.caller_file, c.caller, c.callee, count(d.file) AS candidates, CASE WHEN count(d.file) = 1 THEN min(d.file) END AS callee_file FROM calls c LEFT JOIN (SELECT DISTINCT name, file FROM symbols) d ON c.callee = d.name AND d.file <> c.caller_file GROUP BY 1, 2, 3",
    "refs", "symbols", _BODIES, _CALLS,
)
def cross_file_calls(ix):
    return S.cross_file_calls(ix.once("refs", "file", "name", "kind", "line"), ix.symbols)


@query(
    f"SELECT DISTINCT e.path, a.id FROM (SELECT DISTINCT path FROM edits WHERE ts >= {AS_OF - 30 * DAY}) e JOIN t ON t.path = e.path JOIN annotations a ON a.target = t.target WHERE a.expires_at IS NULL OR a.expires_at > {AS_OF}",
    "edits", "annotations", "symbols",
    "t AS (SELECT path, path AS target FROM edits UNION SELECT s.file, s.file || '#' || s.name || x.s FROM symbols s, (VALUES (''), ('.'), ('#'), ('/'), ('!')) x(s) WHERE s.name IS NOT NULL)",
)
def notes_of_changed_files(ix):
    changed = ix.edits.where(F.col("ts") >= AS_OF - 30 * DAY).select("path").distinct()
    own = ix.symbols.where("name is not null").select(F.col("file").alias("path"), F.explode(F.array(*(F.concat("file", F.lit("#"), "name", F.lit(s)) for s in ("", ".", "#", "/", "!")))).alias("target"))
    targets = changed.select("path", F.col("path").alias("target")).unionByName(own.join(changed, "path", "left_semi"))
    return ix.once("annotations", "target", "expires_at").where(alive(AS_OF)).select("id", "target").join(targets, "target").select("path", "id").distinct()


@query(
    f"""SELECT path, id, scope FROM (
  SELECT f.path, a.id, 'file' AS scope FROM files f JOIN n a ON a.target = f.path
  UNION ALL SELECT d.path, a.id, 'dir' FROM (SELECT path, unnest({ancestors_sql("path")}) AS t FROM files) d JOIN n a ON a.target = d.t
  UNION SELECT e.src, a.id, 'dep' FROM (SELECT DISTINCT src, dst FROM edges WHERE type = 'imports') e JOIN files f ON e.src = f.path JOIN n a ON a.target = e.dst)""",
    "files", "annotations", "edges", f"n AS (SELECT id, target FROM annotations WHERE expires_at IS NULL OR expires_at > {AS_OF})",
)
def path_annotations(ix):
    notes = ix.once("annotations", "target", "expires_at").where(alive(AS_OF)).select("id", "target")
    here = ix.files.select("path", F.col("path").alias("target"), F.lit("file").alias("scope"))
    above = ix.files.select("path", F.explode(ancestors(F.col("path"))).alias("target"), F.lit("dir").alias("scope"))
    deps = ix.once("edges", "src", "dst", "type").where("type = 'imports'").select(F.col("src").alias("path"), F.col("dst").alias("target")).distinct().join(ix.files.select("path"), "path", "left_semi").withColumn("scope", F.lit("dep"))
    return notes.join(here.unionByName(above).unionByName(deps), "target").select("path", "id", "scope")


@query("SELECT DISTINCT a.m AS module, b.m AS prefix FROM m a JOIN m b ON starts_with(a.m, b.m || '.')", "edges", "m AS (SELECT DISTINCT substr(dst, 8) AS m FROM edges WHERE starts_with(dst, 'module:'))")
def prefix_check(ix):
    return B.shadowed_modules(ix.once("edges", "dst")).select("module", "prefix")


@query(
    "SELECT id, target FROM annotations, (SELECT 1) WHERE EXISTS (SELECT 1 FROM (SELECT unnest(evidence) AS e) WHERE e.object = 'x') OR list_contains(list_transform(evidence, lambda e: e.subject), 'emit_event')",
    "annotations",
)
def evidence_query(ix):
    return ix.once("annotations", "target", "evidence").where(F.exists("evidence", lambda e: (e["subject"] == "emit_event") | (e["object"] == "x"))).select("id", "target")


@query(
    "SELECT i.src AS file, i.name, s.symbol_id FROM i JOIN (SELECT file, min(symbol_id) AS symbol_id FROM symbols WHERE symbol_id IS NOT NULL GROUP BY file HAVING count(*) = 1) s ON i.dst = s.file WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.file = i.src AND r.name = i.name)",
    "edges", "symbols", "refs",
    "i AS (SELECT DISTINCT src, dst, regexp_extract(regexp_extract(dst, '[^/]*$'), '^([^.]*)', 1) AS name FROM edges WHERE type = 'imports' AND src IS NOT NULL AND dst IS NOT NULL AND NOT regexp_matches(dst, '^(module|builtin|binding):'))",
)
def default_import_refs(ix):
    stem = F.regexp_extract(F.regexp_extract("dst", r"([^/]*)$", 1), r"^([^.]*)", 1)
    imports = ix.once("edges", "src", "dst", "type").where((F.col("type") == "imports") & F.col("src").isNotNull() & B.is_internal(F.col("dst"))).select(F.col("src").alias("file"), "dst", stem.alias("name")).distinct()
    return B.default_import_refs(imports, ix.symbols, ix.once("refs", "file", "name"))
