"""What belongs to one target, over whole tables, and the SQL that says what it means."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import extract, graph, rollups
from codelode.operators import packs as K
from codelode.operators import positions as S
from codelode.operators.reports import dot
from codelode.queries.common import AS_OF, registry
from codelode.queries.graph import TARGET
from codelode.queries.joins import _BODIES

QUERIES, ORACLE, query = registry()
_T = "t AS (SELECT path, text FROM file_texts WHERE text IS NOT NULL)"


@query(
    "SELECT s.file, s.line, left(array_to_string(string_split(t.text, chr(10))[s.line:s.line + 4], chr(10)), 400) AS text FROM (SELECT DISTINCT file, line FROM symbols WHERE kind = 'class' AND line >= 1) s JOIN t ON s.file = t.path WHERE s.line <= len(string_split(t.text, chr(10)))",
    "symbols", _T,
)
def snippets(ix):
    return K.excerpts(ix.symbols.where("kind = 'class'"), ix.texts, 5, 400)


@query("SELECT b.file, b.names AS name, b.line, sha1(array_to_string(string_split(t.text, chr(10))[b.line:b.end_line], chr(10))) AS hash FROM bodies b JOIN t ON b.file = t.path WHERE b.line >= 1 AND b.end_line >= b.line AND b.line <= len(string_split(t.text, chr(10)))", "symbols", _T, _BODIES)
def symbol_body_hash(ix):
    return K.body_hashes(S.bodies(ix.symbols), ix.texts)


@query(f"SELECT path AS file, len(regexp_extract_all(text, '\\bledger\\b'))::INTEGER AS hits FROM t WHERE path IN (SELECT src FROM edges WHERE dst = '{TARGET}' AND type = 'imports')", _T, "edges")
def cross_file_consumers(ix):
    return K.consumers(ix.once("edges", "src", "dst", "type"), ix.texts, TARGET, "ledger")


@query(
    "SELECT DISTINCT i.path, i.spec, coalesce(a.path, b.path, '') AS dst FROM (SELECT path, unnest(regexp_extract_all(text, '(?m)^\\s*#\\s*include\\s+\"([^\"\\n]+)\"', 1)) AS spec FROM t) i LEFT JOIN files a ON a.path = regexp_extract(i.path, '^(.*/)?[^/]*$', 1) || i.spec LEFT JOIN files b ON b.path = split_part(i.path, '/', 1) || '/' || i.spec",
    _T, "files",
)
def resolve_includes(ix):
    return K.includes(ix.texts, ix.files).withColumn("dst", F.coalesce("dst", F.lit("")))


@query(None)
def native_bindings(ix):
    return K.native_bindings(ix.texts)


@query("SELECT id, target FROM annotations WHERE target = 'brinefall/core/kutopoge/journal.js' OR starts_with(target, 'brinefall/core/kutopoge/journal.js#') ORDER BY created_at DESC NULLS LAST, id LIMIT 100", "annotations")
def audit_trail(ix):
    return K.trail(ix.once("annotations", "target", "created_at"), "brinefall/core/kutopoge/journal.js", 100).select("id", "target")


@query(
    f"SELECT DISTINCT path, kind FROM (SELECT path, CASE WHEN regexp_matches(path, '(^|/)(__main__\\.py|main\\.(py|go|c|js|ts)|cli\\.py|index\\.(js|ts))$') THEN 'name' WHEN regexp_matches(text, '(?m)^if\\s+__name__\\s*==\\s*[''\"]__main__[''\"]') OR regexp_matches(text, '(?m)^func\\s+main\\s*\\(\\s*\\)') OR regexp_matches(text, 'public\\s+static\\s+void\\s+main\\s*\\(') THEN 'guard' END AS kind FROM t) WHERE kind IS NOT NULL AND (path = '{TARGET}' OR path IN (SELECT src FROM edges WHERE dst = '{TARGET}' AND type = 'imports'))",
    _T, "edges",
)
def relevant_entrypoints(ix):
    return K.relevant_entrypoints(extract.entrypoints(ix.texts), ix.once("edges", "src", "dst", "type"), TARGET)


@query("SELECT path FROM files WHERE stale = 1 AND (SELECT count(*) FROM files WHERE stale = 1) <= 100000", "files")
def auto_refresh(ix):
    return K.refresh_list(ix.files.where("stale = 1"), 100_000)


@query(
    """SELECT reason, target, score FROM (SELECT 'hub' AS reason, dst AS target, count(*) AS score FROM edges WHERE type = 'imports' AND NOT regexp_matches(dst, '^(module|builtin|binding):') GROUP BY dst
  UNION ALL SELECT 'gateway', name, count(*) FROM refs WHERE kind = 'call' AND name IS NOT NULL GROUP BY name) WHERE target NOT IN (SELECT target FROM annotations WHERE target IS NOT NULL) ORDER BY score DESC, reason, target LIMIT 15""",
    "edges", "refs", "annotations",
)
def seed(ix):
    hubs = rollups.in_degree(ix.once("edges", "dst", "type")).select(F.col("dst").alias("target"), F.col("edges").alias("score"))
    gates = ix.once("refs", "name", "kind").where("kind = 'call' and name is not null").groupBy(F.col("name").alias("target")).agg(F.count("*").alias("score"))
    return K.seeds([("hub", hubs), ("gateway", gates)], ix.once("annotations", "target", "kind"), 15)


@query(
    f"""SELECT DISTINCT section, item FROM (SELECT 'symbols' AS section, name AS item FROM symbols WHERE file = '{TARGET}' UNION ALL SELECT 'imports', dst FROM edges WHERE type = 'imports' AND src = '{TARGET}' UNION ALL SELECT 'importers', src FROM edges WHERE type = 'imports' AND dst = '{TARGET}'
  UNION ALL SELECT 'tests', src FROM edges WHERE type = 'imports' AND dst = '{TARGET}' AND (regexp_matches('/' || lower(src), '/tests?/') OR starts_with(lower(regexp_extract(src, '[^/]*$')), 'test_') OR regexp_matches(lower(src), '_test\\.(py|go)$') OR regexp_matches(lower(regexp_extract(src, '[^/]*$')), '\\.(test|spec)\\.'))
  UNION ALL SELECT 'refers_to', name FROM refs WHERE file = '{TARGET}' UNION ALL SELECT 'notes', CAST(id AS VARCHAR) FROM annotations WHERE (target = '{TARGET}' OR starts_with(target, '{TARGET}#')) AND (expires_at IS NULL OR expires_at > {AS_OF})) WHERE item IS NOT NULL""",
    "symbols", "refs", "edges", "annotations",
)
def build_pack(ix):
    return K.pack(TARGET, ix.symbols, ix.once("refs", "file", "name"), ix.once("edges", "src", "dst", "type"), ix.once("annotations", "target", "expires_at"), AS_OF)


@query(
    f"""SELECT 'regex_consumers' AS finding, count(*) AS items FROM u WHERE src IN (SELECT path FROM files WHERE parser = 'regex') UNION ALL SELECT 'unindexed_consumers', count(*) FROM u WHERE src NOT IN (SELECT path FROM files)
UNION ALL SELECT 'unresolved_imports', count(*) FROM edges WHERE src = '{TARGET}' AND type = 'imports' AND starts_with(dst, 'module:') UNION ALL SELECT 'ambiguous_names', count(*) FROM (SELECT name FROM symbols WHERE name IS NOT NULL GROUP BY name HAVING count(DISTINCT file) > 1 AND bool_or(file = '{TARGET}'))
UNION ALL SELECT 'stale_notes', count(*) FROM annotations WHERE target = '{TARGET}' AND staleness IN ('weakly_stale', 'strongly_stale', 'contradicted')""",
    "symbols", "edges", "files", "annotations", f"u AS (SELECT DISTINCT src FROM edges WHERE dst = '{TARGET}' AND type = 'imports' AND src IS NOT NULL)",
)
def verify_completeness(ix):
    return K.completeness(TARGET, ix.symbols, ix.once("edges", "src", "dst", "type"), ix.files, ix.once("annotations", "target", "staleness"))


@query("SELECT 'now' AS label, file, name, kind, line, symbol_id FROM symbols UNION ALL SELECT label, file, name, kind, line, symbol_id FROM (SELECT DISTINCT label, file, name, kind, line, symbol_id FROM symbol_snapshots WHERE label <> 'audit')", "symbols")
def snapshot_symbols(ix):
    """The snapshots with the current symbols frozen under a new label, and without a deleted one."""
    held = ix.raw("symbol_snapshots").where("label <> 'audit'").select("label", "file", "name", "kind", "line", "symbol_id").distinct()
    return ix.symbols.select(F.lit("now").alias("label"), "file", "name", "kind", "line", "symbol_id").unionByName(held)


@query(None)
def graph_dot(ix):
    """The neighbourhood of a file as one DOT text."""
    edges = ix.once("edges", "src", "dst", "type").where("type = 'imports' and src is not null and dst is not null")
    return ix.spark.createDataFrame([(dot(graph.neighbourhood(edges, TARGET, 1), edges),)], "dot string")
