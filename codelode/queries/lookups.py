"""Point lookups, filters and search over whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import paths as P
from codelode.operators import lookups as L
from codelode.queries.common import AS_OF, DAY, ancestors_sql, registry

NAME, HUB, WORD = "emit_event", "dunmere/pkg/base/base.go", "cache"
QUERIES, ORACLE, query = registry()


@query(f"SELECT file, name, kind, line, symbol_id FROM symbols WHERE name = '{NAME}'", "symbols")
def symbols_by_name(ix):
    return L.by_value(ix.symbols, "name", NAME)


@query(f"SELECT min(symbol_id) AS symbol_id, min(file) AS file FROM symbols WHERE symbol_id = '{HUB}#RetryPolicy#'", "symbols")
def symbol_by_id(ix):
    return L.by_value(ix.symbols, "symbol_id", f"{HUB}#RetryPolicy#").agg(F.min("symbol_id").alias("symbol_id"), F.min("file").alias("file"))


@query(
    "SELECT name, CASE WHEN count(*) FILTER (kind = 'class') = 1 THEN max(symbol_id) FILTER (kind = 'class') WHEN count(*) = 1 THEN max(symbol_id) END AS symbol_id "
    "FROM symbols WHERE name IS NOT NULL GROUP BY name",
    "symbols",
)
def resolve_name_to_symbol_id(ix):
    return L.unique_symbol(ix.symbols, "class")


@query(f"SELECT id, file, kind, line FROM refs WHERE name = '{NAME}' AND kind IN ('call', 'import')", "refs")
def refs_by_name(ix):
    return L.by_value(ix.once("refs", "file", "name", "kind", "line"), "name", NAME, kind=("call", "import")).select("id", "file", "kind", "line")


@query(f"SELECT id, src, dst, confidence FROM edges WHERE src = 'brinefall/core/kutopoge/shared_relay.js' AND type = 'imports'", "edges")
def edges_from(ix):
    return L.by_value(ix.once("edges", "src", "dst", "type", "confidence"), "src", "brinefall/core/kutopoge/shared_relay.js", type="imports").select("id", "src", "dst", "confidence")


@query("SELECT id, src, type FROM edges WHERE dst = 'module:corelib'", "edges")
def edges_to(ix):
    return L.by_value(ix.once("edges", "src", "dst", "type"), "dst", "module:corelib").select("id", "src", "type")


@query(f"SELECT id, target, kind, created_at FROM annotations WHERE kind = 'risk' AND (expires_at IS NULL OR expires_at > {AS_OF})", "annotations")
def list_annotations(ix):
    return L.list_annotations(ix.once("annotations", "target", "kind", "created_at", "expires_at"), AS_OF, kind="risk").select("id", "target", "kind", "created_at")


@query(
    f"SELECT id, target FROM annotations WHERE (contains(lower(body), '{WORD}') OR contains(lower(target), '{WORD}') OR contains(lower(kind), '{WORD}')) AND (expires_at IS NULL OR expires_at > {AS_OF})",
    "annotations",
)
def search_annotations(ix):
    return L.search_annotations(ix.once("annotations", "target", "kind", "body", "expires_at"), WORD, AS_OF).select("id", "target")


@query(
    "SELECT DISTINCT t.path, a.id FROM annotations a JOIN t ON a.target = t.target WHERE a.expires_at IS NULL OR a.expires_at > " + str(AS_OF),
    "annotations",
    "files",
    "symbols",
    f"""t AS (SELECT path, path AS target FROM files UNION SELECT f.path, f.path || '#' || s.name || x.s FROM files f JOIN symbols s ON s.file = f.path, (VALUES (''), ('.'), ('#'), ('/'), ('!')) x(s)
  WHERE s.name IS NOT NULL UNION SELECT path, unnest({ancestors_sql("path")}) FROM files)""",
)
def annotations_for_pack(ix):
    return L.annotations_of_files(ix.once("annotations", "target", "expires_at"), ix.files.select("path"), ix.symbols, AS_OF)


@query(
    f"""SELECT 'notes' AS bucket, CAST(id AS VARCHAR) AS key, target AS place FROM (SELECT * FROM annotations
  WHERE (contains(lower(body), '{WORD}') OR contains(lower(target), '{WORD}') OR contains(lower(kind), '{WORD}')) AND (expires_at IS NULL OR expires_at > {AS_OF}) ORDER BY created_at DESC NULLS LAST, id LIMIT 25)
UNION ALL SELECT 'symbols', name, file FROM (SELECT * FROM symbols WHERE contains(lower(name), '{WORD}') ORDER BY name, file, kind, line LIMIT 25)
UNION ALL SELECT 'files', path, coalesce(lang, 'other') FROM (SELECT * FROM files WHERE contains(lower(path), '{WORD}') ORDER BY path LIMIT 25)""",
    "annotations", "symbols", "files",
)
def search(ix):
    return L.search(WORD, 25, AS_OF, ix.once("annotations", "target", "kind", "body", "created_at", "expires_at"), ix.symbols, ix.files)


@query(
    f"""SELECT * FROM (SELECT 'file' AS kind, path AS value FROM files WHERE contains(lower(path), '{WORD}') ORDER BY length(path), path LIMIT 5)
UNION ALL SELECT * FROM (SELECT DISTINCT 'symbol', name FROM symbols WHERE contains(lower(name), '{WORD}') ORDER BY length(name), name LIMIT 5)""",
    "files", "symbols",
)
def target_suggestions(ix):
    return L.suggestions(ix.files, ix.symbols, WORD)


@query(
    f"""SELECT a.target, CASE min(r) WHEN 1 THEN 'symbol_id' WHEN 2 THEN 'file#symbol' WHEN 3 THEN 'file:symbol' WHEN 4 THEN 'file' WHEN 5 THEN 'directory' WHEN 6 THEN 'symbol' END AS found_as
FROM (SELECT DISTINCT target FROM annotations WHERE target IS NOT NULL) a LEFT JOIN f ON a.target = f.target GROUP BY a.target""",
    "annotations", "symbols", "files",
    f"""f AS (SELECT symbol_id AS target, 1 AS r FROM symbols UNION ALL SELECT file || '#' || name, 2 FROM symbols UNION ALL SELECT file || ':' || name, 3 FROM symbols
  UNION ALL SELECT path, 4 FROM files UNION ALL SELECT unnest({ancestors_sql("path")}), 5 FROM files UNION ALL SELECT name, 6 FROM symbols WHERE file IS NOT NULL)""",
)
def locate(ix):
    return L.locate(ix.once("annotations", "target"), ix.files, ix.symbols)


@query("SELECT id, roles FROM refs WHERE (roles & 24) <> 0", "refs")
def role_mask(ix):
    return L.with_roles(ix.once("refs", "roles"), 24).select("id", "roles")


@query(
    "SELECT roles, count(*) AS refs, list_filter(["
    + ", ".join(f"CASE WHEN (roles & {1 << i}) <> 0 THEN '{n}' END" for i, n in enumerate(L.ROLE_BITS))
    + "], lambda x: x IS NOT NULL) AS names FROM refs WHERE roles IS NOT NULL GROUP BY roles",
    "refs",
)
def roles(ix):
    return ix.once("refs", "roles").where("roles is not null").groupBy("roles").agg(F.count("*").alias("refs")).select("roles", "refs", L.describe_roles(F.col("roles")).alias("names"))


@query("SELECT kind, " + "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.ROLES_OF_KIND.items()) + " ELSE 0 END AS expected, count(*) AS refs FROM refs WHERE kind IS NOT NULL GROUP BY kind", "refs")
def roles_of_kind(ix):
    return ix.once("refs", "kind").where("kind is not null").groupBy("kind").agg(F.count("*").alias("refs")).select("kind", L.roles_of_kind(F.col("kind")).alias("expected"), "refs")


@query("SELECT file, name, kind, line FROM symbols WHERE kind IN ('function', 'class', 'method')", "symbols")
def kind_filter(ix):
    return ix.symbols.where(F.col("kind").isin("function", "class", "method")).select("file", "name", "kind", "line")


@query(
    "SELECT path FROM files WHERE NOT (" + " OR ".join(f"starts_with(path, '{p}') OR path = '{p.rstrip('/')}'" for p in P.VENDOR_PREFIXES + ("brinefall/vendor/", "kestrow/")) + ")",
    "files",
)
def scope_filter(ix):
    return ix.files.where(P.in_scope(F.col("path"), P.VENDOR_PREFIXES + ("brinefall/vendor/", "kestrow/"))).select("path")


_ARTIFACT_SQL = (
    "CASE WHEN d <> '' THEN 'artifact' WHEN regexp_matches(path, '(?i)(^|/)CHANGELOG[_.-]?[A-Z0-9]*\\.md$') THEN 'artifact' "
    + " ".join(f"WHEN regexp_matches(n, '(?i){p}') THEN '{k}'" for p, k, _ in P.ARTIFACT_NAMES)
    + " ELSE 'source' END AS kind, CASE WHEN d <> '' THEN d || '/ directory' WHEN regexp_matches(path, '(?i)(^|/)CHANGELOG[_.-]?[A-Z0-9]*\\.md$') THEN 'changelog markdown' "
    + " ".join(f"WHEN regexp_matches(n, '(?i){p}') THEN '{r}'" for p, _, r in P.ARTIFACT_NAMES)
    + " END AS reason"
)
_PARTS_SQL = "parts AS (SELECT path, regexp_extract(path, '[^/]*$') AS n, regexp_extract(path, '(?:^|/)(" + "|".join(d.replace(".", "\\.") for d in P.ARTIFACT_DIRS) + ")(?:/|$)', 1) AS d FROM files)"


@query(f"SELECT path, {_ARTIFACT_SQL} FROM parts", "files", _PARTS_SQL)
def artifact_filter(ix):
    return ix.files.select("path", P.artifact_class(F.col("path")).alias("x")).select("path", "x.kind", "x.reason")


@query(
    "SELECT path FROM files WHERE regexp_matches('/' || lower(path), '/tests?/') OR starts_with(lower(regexp_extract(path, '[^/]*$')), 'test_') OR regexp_matches(lower(path), '_test\\.(py|go)$') OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.(test|spec)\\.')",
    "files",
)
def is_test_file(ix):
    return ix.files.where(P.is_test(F.col("path"))).select("path")


@query("SELECT path FROM files WHERE regexp_matches(lower(path), '\\.(json|css|md|txt|ya?ml|html)$') OR regexp_matches('/' || lower(path), '/(docs?|examples?|snapshots)/')", "files")
def non_code_filter(ix):
    p = F.lower("path")
    return ix.files.where(p.rlike(r"\.(json|css|md|txt|ya?ml|html)$") | F.concat(F.lit("/"), p).rlike("/(docs?|examples?|snapshots)/")).select("path")


@query("SELECT path FROM files WHERE NOT regexp_matches(lower(path), '\\.(md|markdown|txt|rst|adoc|asciidoc|org|rtf)$')", "files")
def is_doc_only(ix):
    return ix.files.where(~P.is_doc_only(F.col("path"))).select("path")


@query(
    "SELECT path, lang, (SELECT count(*) FROM files WHERE lang = 'python' AND (path LIKE '%/src/%.py' OR path LIKE '%/lib/%')) AS matched, (SELECT count(*) FROM files) AS total "
    "FROM files WHERE lang = 'python' AND (path LIKE '%/src/%.py' OR path LIKE '%/lib/%') ORDER BY path LIMIT 20",
    "files",
)
def files_list(ix):
    return L.list_files(ix.files, ["*/src/**/*.py", "*/src/*.py", "*/lib/*"], "python", 20)


@query(
    f"SELECT p.path, n.id, CASE WHEN p.t = p.path THEN 'file' ELSE 'dir' END AS scope FROM p JOIN (SELECT id, target FROM annotations WHERE kind = 'exclude' AND (expires_at IS NULL OR expires_at > {AS_OF})) n ON n.target = p.t",
    "annotations", "files", f"p AS (SELECT path, path AS t FROM files UNION ALL SELECT path, unnest({ancestors_sql('path')}) FROM files)",
)
def exclusion_ancestors(ix):
    return L.covering_targets(ix.files, ix.once("annotations", "target", "kind", "expires_at"), AS_OF)


@query(f"SELECT id FROM annotations WHERE target = '@project' AND kind IN ('guidance', 'constraint', 'preference', 'critical', 'exclude') AND (expires_at IS NULL OR expires_at > {AS_OF})", "annotations")
def guidance_kinds(ix):
    return L.project_notes(ix.once("annotations", "target", "kind", "expires_at"), AS_OF, L.GUIDANCE_KINDS)


@query(f"SELECT s.name, s.kind, s.line, f.path IS NOT NULL AS indexed FROM symbols s LEFT JOIN files f ON s.file = f.path WHERE s.file = '{HUB}'", "symbols", "files")
def symbol_in_file(ix):
    found = ix.symbols.where(F.col("file") == HUB)
    return found.join(ix.files.select(F.col("path").alias("file"), F.lit(True).alias("indexed")), "file", "left").select("name", "kind", "line", F.coalesce("indexed", F.lit(False)).alias("indexed"))


@query(
    f"""SELECT DISTINCT 'def' AS what, file, line FROM symbols WHERE name = '{NAME}'
UNION ALL SELECT 'ref', file, line FROM refs WHERE name = '{NAME}' AND ((SELECT count(*) FROM b) = 0 OR id IN (SELECT id FROM b))""",
    "symbols", "refs", f"b AS (SELECT id FROM refs WHERE name = '{NAME}' AND target_symbol_id IN (SELECT symbol_id FROM symbols WHERE name = '{NAME}'))",
)
def symbol_refs(ix):
    return L.symbol_references(ix.symbols, ix.once("refs", "file", "name", "line", "target_symbol_id"), NAME)


@query(f"SELECT path, new_hash, ts, session_id FROM edits WHERE ts >= {AS_OF - 30 * DAY}", "edits")
def recent_edits(ix):
    return L.recent_edits(ix.edits, since=AS_OF - 30 * DAY).select("path", "new_hash", "ts", "session_id")


@query(f"SELECT id, target, created_at FROM annotations WHERE created_at BETWEEN {AS_OF - 90 * DAY} AND {AS_OF}", "annotations")
def notes_in_window(ix):
    return ix.once("annotations", "target", "created_at").where(F.col("created_at").between(AS_OF - 90 * DAY, AS_OF)).select("id", "target", "created_at")


@query(f"SELECT '{NAME}' AS name, (SELECT count(*) FROM refs WHERE name = '{NAME}') AS total, file, line FROM (SELECT DISTINCT file, line FROM refs WHERE name = '{NAME}' AND file IS NOT NULL ORDER BY file, line LIMIT 5)", "refs")
def ref_sites(ix):
    return L.reference_sites(ix.once("refs", "file", "name", "line"), NAME)


@query("SELECT DISTINCT kind, name, file || '#' || name || CASE WHEN kind IN ('class', 'interface', 'struct', 'enum', 'trait', 'type', 'type_alias', 'union', 'protocol') THEN '#' WHEN kind IN ('module', 'object', 'package', 'namespace') THEN '/' WHEN kind = 'macro' THEN '!' ELSE '.' END AS built FROM symbols WHERE file <> '' AND name <> ''", "symbols")
def symbol_id_build(ix):
    return ix.symbols.where("file <> '' and name <> ''").select("kind", "name", P.symbol_id(F.col("file"), F.col("name"), F.col("kind")).alias("built")).distinct()


@query(
    """SELECT symbol_id, split_part(symbol_id, '#', 1) AS file, regexp_replace(regexp_extract(symbol_id, '#(.*)$', 1), '[.#/!]$', '') AS name,
  nullif(regexp_extract(regexp_extract(symbol_id, '#(.*)$', 1), '[.#/!]$'), '') AS suffix FROM (SELECT DISTINCT symbol_id FROM symbols WHERE contains(symbol_id, '#'))""",
    "symbols",
)
def symbol_id_parse(ix):
    ids = ix.symbols.where(F.col("symbol_id").contains("#")).select("symbol_id").distinct()
    return ids.select("symbol_id", P.parse_symbol_id(F.col("symbol_id")).alias("x")).select("symbol_id", "x.file", "x.name", "x.suffix")


@query(
    """SELECT target, CASE WHEN contains(target, '#') THEN nullif(split_part(target, '#', 1), '') WHEN contains(regexp_extract(target, '[^/]*$'), '.') AND NOT starts_with(target, '$') THEN target END AS file,
  CASE WHEN contains(target, '#') THEN nullif(regexp_extract(target, '#([^.#/!]*)', 1), '') END AS name FROM (SELECT DISTINCT target FROM annotations WHERE target IS NOT NULL)""",
    "annotations",
)
def target_parse(ix):
    targets = ix.once("annotations", "target").where("target is not null").select("target").distinct()
    return targets.select("target", P.parse_target(F.col("target")).alias("x")).select("target", "x.file", "x.name")


@query("SELECT dst, count(*) AS edges FROM edges WHERE regexp_matches(dst, '^(module|builtin|binding):') GROUP BY dst", "edges")
def external_nodes(ix):
    return ix.once("edges", "dst").where(P.is_virtual(F.col("dst"))).groupBy("dst").agg(F.count("*").alias("edges"))


@query(
    """SELECT l.id AS lease, f.current_path, l.opened_at, l.expires_at FROM leases l JOIN file_lifeline f ON l.lifeline_id = f.id WHERE l.state = 'open'""",
    "leases",
)
def open_leases(ix):
    joined = ix.leases.where("state = 'open'").join(ix.lifelines.select(F.col("id").alias("lifeline_id"), "current_path"), "lifeline_id")
    return joined.select(F.col("id").alias("lease"), "current_path", "opened_at", "expires_at")


@query("SELECT id, target FROM annotations WHERE starts_with(target, 'brinefall/') AND kind = 'todo'", "annotations")
def notes_by_prefix(ix):
    return ix.once("annotations", "target", "kind").where(F.col("target").startswith("brinefall/") & (F.col("kind") == "todo")).select("id", "target")
