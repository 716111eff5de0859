"""Counts, shares and top-k over whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions.paths import SOURCE_ROOTS
from codelode.operators import budget, rollups as R
from codelode.operators.lookups import alive
from codelode.queries.common import AS_OF, DAY, registry

QUERIES, ORACLE, query = registry()
_VIRTUAL = "regexp_matches(dst, '^(module|builtin|binding):')"
_ARTIFACT = (
    "(regexp_matches({0}, '(^|/)(dist|build|out|generated|__generated__|auto_generated|coverage|node_modules|vendor|third_party|third-party|tests/baselines|testRunner/fixtures|changelogs|doc/changelogs|__snapshots__)(/|$)') "
    "OR regexp_matches({0}, '(?i)((^|/)CHANGELOG[_.-]?[A-Z0-9]*\\.md|\\.snap|\\.baseline|\\.bak|\\.min\\.(js|css)|\\.bundle\\.(js|css)|\\.map|\\.lock|\\.lockb|_pb2\\.py|_pb2_grpc\\.py|\\.pb\\.go|\\.d\\.ts)$'))"
)


@query(
    "SELECT 'files' AS \"table\", count(*) AS \"rows\" FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'edges', count(*) FROM edges "
    "UNION ALL SELECT 'annotations', count(*) FROM annotations UNION ALL SELECT 'stale_files', count(*) FROM files WHERE stale = 1",
    "files", "symbols", "refs", "edges", "annotations",
)
def stats(ix):
    return R.table_counts({"files": ix.files, "symbols": ix.symbols, "refs": ix.once("refs"), "edges": ix.once("edges"), "annotations": ix.once("annotations"), "stale_files": ix.files.where("stale = 1")})


@query(
    "SELECT *, CASE WHEN total > 0 THEN round(100.0 * ast / total, 1) ELSE 0 END::DOUBLE AS ast_pct FROM (SELECT coalesce(lang, 'unknown') AS lang, count(*) FILTER (starts_with(parser, 'treesitter:') OR parser = 'ast') AS ast, count(*) FILTER (parser = 'regex') AS regex, "
    "count(*) FILTER (NOT coalesce(starts_with(parser, 'treesitter:') OR parser = 'ast' OR parser = 'regex', false)) AS none, count(*) AS total FROM files GROUP BY ROLLUP (coalesce(lang, 'unknown')))",
    "files",
)
def parser_coverage(ix):
    return R.parser_coverage(ix.files)


@query("SELECT coalesce(parser, 'none') AS parser, count(*) AS files FROM files GROUP BY 1", "files")
def parser_distribution(ix):
    return ix.files.groupBy(F.coalesce("parser", F.lit("none")).alias("parser")).agg(F.count("*").alias("files"))


@query(
    "SELECT * FROM (SELECT kind, count(*) AS symbols, count(DISTINCT name) AS names FROM symbols GROUP BY kind) JOIN (SELECT kind, list(name ORDER BY n DESC, name) AS top_names FROM (SELECT kind, name, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS rn FROM symbols WHERE name IS NOT NULL GROUP BY kind, name) WHERE rn <= 3 GROUP BY kind) USING (kind)",
    "symbols",
)
def known_names_summary(ix):
    counts = ix.symbols.groupBy("kind").agg(F.count("*").alias("symbols"), F.count_distinct("name").alias("names"))
    named = ix.symbols.where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))
    top = R.top_k_per_key(named, "kind", 3, F.desc("n"), F.asc("name")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(-F.col("n"), "name"))).alias("t"))
    return counts.join(top.select("kind", F.col("t.name").alias("top_names")), "kind")


@query(f"SELECT dst AS file, count(*) AS reverse_deps FROM edges WHERE type = 'imports' AND NOT {_VIRTUAL} AND dst IN (SELECT path FROM files) GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10", "edges", "files")
def hot_files(ix):
    return R.hot_files(ix.once("edges", "dst", "type"), ix.files, 10)


@query(
    f"SELECT dst AS file, count(*) AS reverse_deps FROM edges WHERE type = 'imports' AND NOT {_VIRTUAL} AND dst IN (SELECT path FROM files) AND (regexp_matches(dst, '(^|/)(index|barrel)(\\.[^/]*)?$') OR regexp_matches(dst, '/(_namespaces|_ns)/')) GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10",
    "edges", "files",
)
def barrel_candidates(ix):
    return R.barrel_candidates(ix.once("edges", "dst", "type"), ix.files, 10)


_FIRST = "first AS (SELECT name, file, line, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file NULLS FIRST, line NULLS FIRST, kind NULLS FIRST) AS rn FROM symbols WHERE name IS NOT NULL AND {0}) WHERE rn = 1)"


@query(
    "SELECT r.name, r.n AS ref_count, f.file, f.line FROM (SELECT name, count(*) AS n FROM refs WHERE kind = 'call' AND length(name) >= 3 GROUP BY name) r JOIN first f ON r.name = f.name ORDER BY 2 DESC, 1 LIMIT 10",
    "refs", "symbols", _FIRST.format("kind IN ('function', 'method', 'exported')"),
)
def gateway_symbols(ix):
    return R.gateway_symbols(ix.once("refs", "file", "name", "kind", "line"), ix.symbols, 10)


@query(
    "SELECT f.name, f.file, f.kind, count(r.id) AS refcount FROM first f LEFT JOIN refs r ON r.name = f.name GROUP BY ALL ORDER BY 4 DESC, 1 LIMIT 20",
    "refs", "symbols", _FIRST.format("kind IS NOT NULL AND NOT regexp_matches(name, '^__.*__$') AND NOT coalesce(" + _ARTIFACT.format("file") + ", false)"),
)
def god_symbols(ix):
    return R.god_symbols(ix.symbols, ix.once("refs", "file", "name", "kind", "line"), 20)


@query("SELECT s.name, s.n AS def_count, coalesce(r.n, 0) AS ref_count FROM (SELECT name, count(*) AS n FROM symbols WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1) s LEFT JOIN (SELECT name, count(*) AS n FROM refs GROUP BY name) r ON s.name = r.name", "symbols", "refs")
def ambiguous_refs(ix):
    return R.ambiguous_refs(ix.symbols, ix.once("refs", "name"))


_MODULE = "CASE WHEN root IS NOT NULL AND starts_with({0}, root || '/') THEN regexp_extract({0}, '^[^/]*/[^/]*') ELSE split_part({0}, '/', 1) END"
_ROOT = "r AS (SELECT (SELECT seg FROM (SELECT split_part(path, '/', 1) AS seg, count(*) AS n FROM files WHERE contains(path, '/') AND split_part(path, '/', 1) IN ('src', 'app', 'lib', 'packages', 'internal', 'pkg') GROUP BY 1) WHERE n >= greatest(1, (SELECT count(*) FROM files) // 4) ORDER BY n DESC, seg LIMIT 1) AS root)"


@query(
    f"""SELECT a.module, a.files, coalesce(b.symbols, 0) AS symbols, coalesce(b.functions, 0) AS functions, coalesce(b.classes, 0) AS classes, coalesce(c.refs, 0) AS refs
FROM (SELECT {_MODULE.format("path")} AS module, count(*) AS files FROM files, r GROUP BY 1) a
LEFT JOIN (SELECT {_MODULE.format("file")} AS module, count(*) AS symbols, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'class') AS classes FROM symbols, r WHERE file IN (SELECT path FROM files) GROUP BY 1) b ON a.module = b.module
LEFT JOIN (SELECT {_MODULE.format("file")} AS module, count(*) AS refs FROM refs, r WHERE file IS NOT NULL GROUP BY 1) c ON a.module = c.module""",
    "files", "symbols", "refs", _ROOT,
)
def module_stats(ix):
    return R.module_stats(ix.files, ix.symbols, ix.once("refs", "file", "kind"), R.source_root(ix.files, SOURCE_ROOTS))


@query(
    f"""SELECT from_module, to_module, sum(n)::BIGINT AS edge_count, list(x ORDER BY x) FILTER (rn <= 3) AS examples FROM (
  SELECT {_MODULE.format("src")} AS from_module, {_MODULE.format("dst")} AS to_module, src || ' -> ' || dst AS x, count(*) AS n, row_number() OVER (PARTITION BY from_module, to_module ORDER BY src, dst) AS rn
  FROM edges, r WHERE type = 'imports' AND src IS NOT NULL AND dst IS NOT NULL AND NOT {_VIRTUAL} GROUP BY from_module, to_module, src, dst) WHERE from_module <> to_module GROUP BY 1, 2""",
    "edges", "files", _ROOT,
)
def cross_module_edges(ix):
    return R.cross_module_edges(ix.once("edges", "src", "dst", "type"), R.source_root(ix.files, SOURCE_ROOTS))


@query(
    "SELECT 'staleness' AS dimension, coalesce(staleness, 'unknown') AS value, count(*) AS notes FROM annotations GROUP BY 2 UNION ALL SELECT 'truth_class', coalesce(truth_class, 'INFERENCE'), count(*) FROM annotations GROUP BY 2 "
    "UNION ALL SELECT 'kind', coalesce(kind, 'note'), count(*) FROM annotations GROUP BY 2 UNION ALL SELECT 'author', author, count(*) FROM annotations WHERE author IS NOT NULL GROUP BY 2",
    "annotations",
)
def notes_totals(ix):
    return R.note_totals(ix.once("annotations", "kind", "author", "truth_class", "staleness"))


@query("SELECT target, count(*) AS note_count, count(*) FILTER (staleness IN ('weakly_stale', 'strongly_stale', 'contradicted')) AS stale_note_count, count(*) FILTER (staleness = 'contradicted') AS contradicted_count FROM annotations WHERE target IS NOT NULL GROUP BY target HAVING stale_note_count > 0", "annotations")
def target_risk(ix):
    return R.target_risk(ix.once("annotations", "target", "staleness"))


@query(
    "SELECT e.subject AS subject, count(*) AS claims, count(DISTINCT id) AS notes, list_sort(list(DISTINCT e.predicate)) AS predicates FROM (SELECT id, unnest(evidence) AS e FROM annotations WHERE staleness = 'contradicted') WHERE e.subject IS NOT NULL GROUP BY 1",
    "annotations",
)
def audit_by_subject(ix):
    claims = ix.once("annotations", "evidence", "staleness").where("staleness = 'contradicted'").select("id", F.explode("evidence").alias("e")).where("e.subject is not null")
    # few predicates exist, so the set of them is small
    return claims.groupBy(F.col("e.subject").alias("subject")).agg(F.count("*").alias("claims"), F.count_distinct("id").alias("notes"), F.array_sort(F.collect_set("e.predicate")).alias("predicates"))


@query("SELECT path, count(*) AS hashes FROM (SELECT DISTINCT path, new_hash FROM edits WHERE new_hash IS NOT NULL AND path IS NOT NULL) GROUP BY path HAVING count(*) > 1", "edits")
def value_drift(ix):
    return R.distinct_values(ix.edits.where("path is not null"), ("path",), "new_hash").withColumnRenamed("values", "hashes")


@query(
    """SELECT a.name, a.l AS layer_a, b.l AS layer_b, list_filter(a.m, lambda x: NOT list_contains(b.m, x)) AS only_a, list_filter(b.m, lambda x: NOT list_contains(a.m, x)) AS only_b
FROM k a JOIN k b ON a.name = b.name AND a.l < b.l WHERE a.m <> b.m""",
    "symbols", "files",
    "k AS (SELECT s.name, f.lang AS l, list_sort(list(DISTINCT s.kind)) AS m FROM symbols s JOIN files f ON s.file = f.path WHERE s.name IS NOT NULL AND f.lang IS NOT NULL GROUP BY 1, 2)",
)
def cross_layer_mismatch(ix):
    """Names whose kinds differ between languages: the form of enum members by layer, on symbols."""
    spoken = ix.symbols.where("name is not null").join(ix.files.select(F.col("path").alias("file"), "lang"), "file").where("lang is not null")
    return R.differing_members(spoken.select("name", "lang", F.array("kind").alias("kinds")).distinct(), "name", "lang", "kinds")


@query(f"SELECT path, count(*) AS edits, max(ts) AS last_ts, max(summary) AS summary FROM edits WHERE path IS NOT NULL AND ts BETWEEN {AS_OF - 120 * DAY} AND {AS_OF} GROUP BY path", "edits")
def touched_files_in_window(ix):
    return R.touched_files(ix.edits, AS_OF - 120 * DAY, AS_OF)


@query(
    "SELECT coalesce(h.label, k.label) AS label, coalesce(k.t, h.t) AS taken_at, coalesce(h.n, 0) AS \"rows\" FROM (SELECT label, min(ts) AS t, count(*) AS n FROM symbol_snapshots WHERE label IS NOT NULL GROUP BY label) h "
    "FULL JOIN (SELECT label, max(taken_at) AS t FROM snapshot_labels WHERE label IS NOT NULL GROUP BY label) k ON h.label = k.label"
)
def list_snapshots(ix):
    return R.list_snapshots(ix.raw("symbol_snapshots"), ix.raw("snapshot_labels"))


@query(
    """SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS edit_count, count(DISTINCT session_id) AS sessions,
  first(prev_hash ORDER BY (ts IS NULL), ts, prev_hash NULLS FIRST, new_hash NULLS FIRST, session_id NULLS FIRST) AS prev_hash,
  first(new_hash ORDER BY ts DESC NULLS LAST, new_hash DESC NULLS LAST, prev_hash DESC NULLS LAST, session_id DESC NULLS LAST) AS new_hash,
  bool_or(prev_hash IS NULL) AS was_added, bool_or(new_hash IS NULL) AS was_deleted FROM edits WHERE path IS NOT NULL GROUP BY path""",
    "edits",
)
def edit_log_collapse(ix):
    return R.collapse_edits(ix.edits)


@query("SELECT file, kind, min(name) AS name FROM symbols WHERE file IS NOT NULL GROUP BY file, kind", "symbols")
def dedupe_first(ix):
    return R.first_of_each(ix.symbols.where("file is not null").select("file", "kind", "name"), ("file", "kind"), "name")


@query(
    "SELECT file, ['unknown', 'low', 'medium', 'high'][1 + min(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)] AS confidence, count(*) AS \"rows\" FROM refs WHERE file IS NOT NULL GROUP BY file",
    "refs",
)
def min_confidence(ix):
    return R.min_confidence(ix.once("refs", "file", "confidence"), "file")


@query(
    "SELECT target, ['fresh', 'recovered', 'unknown', 'weakly_stale', 'strongly_stale', 'contradicted'][1 + max(CASE staleness WHEN 'fresh' THEN 0 WHEN 'recovered' THEN 1 WHEN 'weakly_stale' THEN 3 WHEN 'strongly_stale' THEN 4 WHEN 'contradicted' THEN 5 ELSE 2 END)] AS staleness, "
    "coalesce(bool_or(kind = 'critical' OR coalesce(severity IN ('critical', 'high'), false)), false) AS critical FROM annotations WHERE target IS NOT NULL GROUP BY target",
    "annotations",
)
def worst_staleness(ix):
    return R.worst_staleness(ix.once("annotations", "target", "kind", "staleness", "severity"))


@query(
    f"""SELECT name, file, CASE WHEN t > 0 THEN round(b / t, 4) ELSE 0 END::DOUBLE AS share FROM (SELECT d.name, d.file, coalesce(b.b, 0) AS b, sum(coalesce(b.b, 0)) OVER (PARTITION BY d.name) AS t, count(*) OVER (PARTITION BY d.name) AS n,
  row_number() OVER (PARTITION BY d.name ORDER BY (regexp_matches('/' || lower(d.file), '/tests?/') OR starts_with(lower(regexp_extract(d.file, '[^/]*$')), 'test_') OR regexp_matches(lower(d.file), '_test\\.(py|go)$') OR regexp_matches(lower(regexp_extract(d.file, '[^/]*$')), '\\.(test|spec)\\.') OR {_ARTIFACT.format("d.file")}), coalesce(b.b, 0) DESC, length(d.file), d.file) AS rn
  FROM (SELECT DISTINCT name, file FROM symbols WHERE name IS NOT NULL AND file IS NOT NULL) d LEFT JOIN (SELECT name, split_part(target_symbol_id, '#', 1) AS file, count(*) AS b FROM refs WHERE target_symbol_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2) b ON d.name = b.name AND d.file = b.file) WHERE rn = 1 AND n > 1""",
    "symbols", "refs",
)
def primary_def_share(ix):
    return R.primary_definitions(ix.symbols, ix.once("refs", "file", "name", "target_symbol_id"))


@query("SELECT name, n AS refs, CASE WHEN n <= 5 THEN 'small' WHEN n <= 50 THEN 'medium' ELSE 'large' END AS size FROM (SELECT name, count(*) AS n FROM refs WHERE name IS NOT NULL GROUP BY name)", "refs")
def refcount(ix):
    counts = ix.once("refs", "name").where("name is not null").groupBy("name").agg(F.count("*").alias("refs"))
    return counts.withColumn("size", R.size_class(F.col("refs")))


@query("SELECT coalesce(confidence, 'unknown') AS level, count(*) AS \"rows\", (sum(count(*)) OVER ())::BIGINT AS total, row_number() OVER (ORDER BY count(*) DESC, level DESC) = 1 AS dominant FROM refs GROUP BY 1", "refs")
def confidence_summary(ix):
    return R.level_summary(ix.once("refs", "confidence"), "confidence")


@query("SELECT sum(len(list_filter(evidence, lambda e: e.predicate IS NOT NULL AND e.predicate <> '')))::BIGINT AS claims, count(*) FILTER (len(evidence) > 0) AS notes FROM annotations", "annotations")
def claims_total(ix):
    return ix.once("annotations", "evidence").agg(F.sum(F.size(F.filter("evidence", lambda e: e["predicate"] != ""))).alias("claims"), F.count_if(F.size("evidence") > 0).alias("notes"))


@query("SELECT author, count(*) AS notes FROM annotations WHERE author IS NOT NULL GROUP BY author ORDER BY 2 DESC, 1 LIMIT 10", "annotations")
def author_rollup(ix):
    return R.top_k(ix.once("annotations", "author").where("author is not null").groupBy("author").agg(F.count("*").alias("notes")), 10, F.desc("notes"), "author")


@query("SELECT CASE WHEN e.predicate = 'called_by' THEN e.object ELSE e.subject END AS target, count(*) AS claims FROM (SELECT unnest(evidence) AS e FROM annotations) GROUP BY 1", "annotations")
def claims_by_target(ix):
    e = ix.once("annotations", "target", "evidence").select(F.explode("evidence").alias("e"))
    return e.groupBy(F.when(F.col("e.predicate") == "called_by", F.col("e.object")).otherwise(F.col("e.subject")).alias("target")).agg(F.count("*").alias("claims"))


@query("SELECT file, count(*) AS refs, count(DISTINCT name) AS names FROM refs WHERE file IS NOT NULL GROUP BY file ORDER BY 2 DESC, 1 LIMIT 10", "refs")
def top_files(ix):
    pairs = ix.once("refs", "file", "name").where("file is not null").groupBy("file", "name").agg(F.count("*").alias("n"))
    return R.top_k(pairs.groupBy("file").agg(F.sum("n").alias("refs"), F.count("name").alias("names")), 10, F.desc("refs"), "file")


@query("SELECT lifeline_id, id, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY lifeline_id ORDER BY \"at\" DESC NULLS LAST, id DESC) AS rn FROM events WHERE lifeline_id IS NOT NULL) WHERE rn <= 10", "events")
def lifeline_history(ix):
    return R.top_k_per_key(ix.events.where("lifeline_id is not null"), "lifeline_id", 10, F.desc_nulls_last("at"), F.desc("id")).select("lifeline_id", "id", "at")


@query("SELECT current_path, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY current_path ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM file_lifeline WHERE current_path IS NOT NULL AND tombstoned_at IS NULL) WHERE rn = 1")
def active_lifeline(ix):
    live = ix.lifelines.where("current_path is not null and tombstoned_at is null")
    return live.groupBy("current_path").agg(F.max(F.struct("created_at", "id")).alias("x")).select("current_path", "x.id", "x.created_at")


@query("SELECT current_path, max(tombstoned_at) AS tombstoned_at, coalesce(len(max_by(replaced_by, (tombstoned_at, id))), 0) AS replaced FROM file_lifeline WHERE current_path IS NOT NULL AND tombstoned_at IS NOT NULL GROUP BY current_path")
def recent_tombstone(ix):
    dead = ix.lifelines.where("current_path is not null and tombstoned_at is not null")
    best = dead.groupBy("current_path").agg(F.max("tombstoned_at").alias("tombstoned_at"), F.max_by("replaced_by", F.struct("tombstoned_at", "id")).alias("r"))
    return best.select("current_path", "tombstoned_at", F.when(F.col("r").isNull(), 0).otherwise(F.size("r")).cast("long").alias("replaced"))


@query("SELECT session_id FROM edits WHERE session_id IS NOT NULL ORDER BY ts DESC NULLS LAST, session_id DESC LIMIT 1", "edits")
def latest_session(ix):
    return ix.edits.where("session_id is not null").agg(F.max(F.struct("ts", "session_id"))["session_id"].alias("session_id"))


@query(
    f"""SELECT id, target, rank FROM (SELECT id, target, CASE WHEN target = '@project' THEN 4 WHEN ends_with(target, '/') THEN 3 WHEN contains(target, '#') THEN 1 ELSE 2 END AS rank, created_at FROM annotations WHERE kind = 'guidance' AND target IS NOT NULL AND (expires_at IS NULL OR expires_at > {AS_OF}))
ORDER BY rank, created_at DESC NULLS LAST, id LIMIT 25""",
    "annotations",
)
def guidance_by_scope(ix):
    t = F.col("target")
    rank = F.when(t == "@project", 4).when(t.endswith("/"), 3).when(t.contains("#"), 1).otherwise(2)
    notes = ix.once("annotations", "target", "kind", "created_at", "expires_at").where((F.col("kind") == "guidance") & t.isNotNull() & alive(AS_OF)).withColumn("rank", rank)
    return R.top_k(notes, 25, "rank", F.desc_nulls_last("created_at"), "id").select("id", "target", "rank")


@query(
    """SELECT id, staleness, confidence FROM annotations ORDER BY CASE staleness WHEN 'fresh' THEN 0 WHEN 'recovered' THEN 1 WHEN 'weakly_stale' THEN 3 WHEN 'strongly_stale' THEN 4 WHEN 'contradicted' THEN 5 ELSE 2 END, confidence DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 50""",
    "annotations",
)
def annotations_order(ix):
    rank = R.rank_of(F.col("staleness"), R.STALENESS_RANK, 2)
    return R.top_k(ix.once("annotations", "created_at", "confidence", "staleness"), 50, rank, F.desc_nulls_last("confidence"), F.desc_nulls_last("created_at"), "id").select("id", "staleness", "confidence")


@query("SELECT id, file, line, (SELECT count(*) FROM refs WHERE name = 'get_config') AS total, (SELECT count(*) FROM refs WHERE name = 'get_config') > 100 AS truncated FROM refs WHERE name = 'get_config' ORDER BY id LIMIT 100", "refs")
def capped_refs(ix):
    hits = ix.once("refs", "file", "name", "line").where("name = 'get_config'")
    total = hits.count()
    return R.top_k(hits, 100, "id").select("id", "file", "line", F.lit(total).cast("long").alias("total"), F.lit(total > 100).alias("truncated"))


@query(
    """SELECT id, cost, spent FROM (SELECT id, cost, (sum(cost) OVER (ORDER BY confidence DESC NULLS LAST, id))::BIGINT AS spent FROM (SELECT id, confidence, greatest(1, CAST(floor(length(body) / 3.5) AS BIGINT) + 1) AS cost FROM annotations WHERE body IS NOT NULL AND target = '@project')) WHERE spent <= 500""",
    "annotations",
)
def fit_to_budget(ix):
    """Notes of one target by falling confidence, as many as a budget of tokens holds."""
    notes = ix.once("annotations", "target", "body", "confidence").where("body is not null and target = '@project'").withColumn("cost", budget.estimate_tokens(F.col("body")))
    return budget.within_budget(notes, "cost", 500, [], F.desc_nulls_last("confidence"), F.asc("id")).select("id", "cost", "spent")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE greatest(1, CAST(floor(length(text) / 3.5) AS BIGINT) + 1) END AS tokens FROM documents")
def estimate_tokens(ix):
    return ix.raw("documents").select("doc_id", budget.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT replaced AS new_id, id AS old_id FROM (SELECT id, unnest(replaced_by) AS replaced FROM file_lifeline)")
def replaced_by_edges(ix):
    return ix.lifelines.select(F.explode("replaced_by").alias("new_id"), F.col("id").alias("old_id"))


@query(
    f"SELECT count(*) AS notes, count(*) FILTER (expires_at IS NULL OR expires_at > {AS_OF}) AS living, count(*) FILTER (staleness = 'contradicted') AS contradicted, count(*) FILTER (created_at >= {AS_OF - 7 * DAY}) AS last_week FROM annotations",
    "annotations",
)
def memory_header(ix):
    return ix.once("annotations", "created_at", "expires_at", "staleness").agg(F.count("*").alias("notes"), F.count_if(alive(AS_OF)).alias("living"), F.count_if(F.col("staleness") == "contradicted").alias("contradicted"), F.count_if(F.col("created_at") >= AS_OF - 7 * DAY).alias("last_week"))

