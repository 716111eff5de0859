"""Graph queries over whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import graph as G
from codelode.operators.lookups import alive
from codelode.operators.positions import cross_file_calls
from codelode.queries.common import AS_OF, registry
from codelode.queries.joins import _BODIES

TARGET = "lanternby/thirdparty/quarrel/rofoseki/quiet_column.go"
QUERIES, ORACLE, query = registry()
_IMPORTS = "i AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'imports' AND src IS NOT NULL AND dst IS NOT NULL)"


def _levels(step: str, seed: str, hops: int, a: str = "src", b: str = "dst") -> tuple[str, ...]:
    """Relations w0..wN: nodes by their first hop, with the smallest parent."""
    out = [f"w0 AS (SELECT {seed} AS node, 0 AS hop, CAST(NULL AS VARCHAR) AS through)"]
    for h in range(1, hops + 1):
        out.append(f"w{h} AS (SELECT node, hop, through FROM w{h - 1} UNION ALL SELECT s.{b}, {h}, min(s.{a}) FROM {step} s JOIN w{h - 1} w ON s.{a} = w.node AND w.hop = {h - 1} WHERE s.{b} NOT IN (SELECT node FROM w{h - 1}) GROUP BY s.{b})")
    return tuple(out)


@query(f"SELECT DISTINCT node FROM (SELECT src AS node FROM edges WHERE dst = '{TARGET}' UNION SELECT dst FROM edges WHERE src = '{TARGET}') WHERE node IS NOT NULL", "edges")
def union_neighbours(ix):
    return G.neighbours(ix.once("edges", "src", "dst"), TARGET)


@query(f"SELECT DISTINCT dst AS file, type FROM edges WHERE src = '{TARGET}' AND type IN ('imports', 'pair_inspect')", "edges")
def forward_deps(ix):
    return G.forward_deps(ix.once("edges", "src", "dst", "type"), TARGET)


@query(
    f"SELECT DISTINCT src AS file, type FROM edges WHERE dst = '{TARGET}' AND type IN ('imports', 'pair_inspect') AND src IS NOT NULL UNION SELECT src, 'reexport_via' FROM i WHERE dst IN (SELECT node FROM w8 WHERE hop > 0)",
    "edges", _IMPORTS, "x AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'reexport_star' AND src IS NOT NULL AND dst IS NOT NULL)", *_levels("x", f"'{TARGET}'", 8, "dst", "src"),
)
def reverse_deps(ix):
    return G.reverse_deps(ix.once("edges", "src", "dst", "type"), TARGET)


@query(
    "SELECT DISTINCT file, 'same_package_ref' AS type FROM refs WHERE file <> 'dunmere/lib/buvarigi/Widget.java' AND kind IN ('new', 'name', 'call') AND name IN (SELECT name FROM symbols WHERE file = 'dunmere/lib/buvarigi/Widget.java' AND kind IN ('class', 'interface', 'enum')) "
    "UNION SELECT DISTINCT src, type FROM edges WHERE dst IN ('dunmere/lib/buvarigi/Widget.java', 'module:dunmere.lib.buvarigi.Widget') AND type IN ('imports', 'pair_inspect')",
    "refs", "symbols", "edges",
)
def reverse_deps_java(ix):
    return G.reverse_deps(ix.once("edges", "src", "dst", "type"), "dunmere/lib/buvarigi/Widget.java", ix.symbols, ix.once("refs", "file", "name", "kind")).where("type <> 'reexport_via'")


@query("SELECT node AS file, hop, through FROM w3 WHERE hop > 0", "edges", _IMPORTS, *_levels("i", f"'{TARGET}'", 3, "dst", "src"))
def radius_reverse(ix):
    seed = ix.spark.createDataFrame([(TARGET,)], "node string")
    return G.reach(ix.once("edges", "src", "dst", "type").where("type = 'imports'"), seed, 3, forward=False).where("hop > 0").select(F.col("node").alias("file"), "hop", "through")


@query("SELECT node AS file, hop, through FROM w3 WHERE hop > 0", "edges", _IMPORTS, *_levels("i", f"'{TARGET}'", 3))
def radius_forward(ix):
    seed = ix.spark.createDataFrame([(TARGET,)], "node string")
    return G.reach(ix.once("edges", "src", "dst", "type").where("type = 'imports'"), seed, 3).where("hop > 0").select(F.col("node").alias("file"), "hop", "through")


@query(
    """SELECT node AS file, hop, CASE WHEN regexp_matches(node, '(^|/)(dist|build|out|generated|__generated__|auto_generated|coverage|node_modules|vendor|third_party|third-party|tests/baselines|testRunner/fixtures|changelogs|doc/changelogs|__snapshots__)(/|$)')
    OR regexp_matches(node, '(?i)(\\.snap|\\.baseline|\\.bak|\\.min\\.(js|css)|\\.bundle\\.(js|css)|\\.map|\\.lock|\\.lockb|_pb2\\.py|_pb2_grpc\\.py|\\.pb\\.go|\\.d\\.ts)$') THEN 'artifact'
  WHEN regexp_matches('/' || lower(node), '/tests?/') OR starts_with(lower(regexp_extract(node, '[^/]*$')), 'test_') OR regexp_matches(lower(node), '_test\\.(py|go)$') OR regexp_matches(lower(regexp_extract(node, '[^/]*$')), '\\.(test|spec)\\.') THEN 'test' ELSE 'source' END AS what
FROM w2 WHERE hop > 0""",
    "edges", _IMPORTS, *_levels("i", f"'{TARGET}'", 2, "dst", "src"),
)
def analyze_change(ix):
    return G.analyze_change(ix.once("edges", "src", "dst", "type"), TARGET)


_CALLS = "calls AS (SELECT DISTINCT b.file, b.names AS caller, r.name AS callee FROM refs r JOIN bodies b ON r.file = b.file AND r.line BETWEEN b.line AND b.end_line WHERE r.kind = 'call' AND r.name IS NOT NULL AND b.names <> r.name)"


@query("SELECT c.file, c.caller, c.callee FROM calls c WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.file = c.file AND s.name = c.callee)", "refs", "symbols", _BODIES, _CALLS)
def callgraph(ix):
    return G.call_graph(ix.once("refs", "file", "name", "kind", "line"), ix.symbols)


@query("SELECT file, caller, count(*) AS callees FROM calls c WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.file = c.file AND s.name = c.callee) GROUP BY file, caller", "refs", "symbols", _BODIES, _CALLS)
def callgraph_by_caller(ix):
    return G.call_graph(ix.once("refs", "file", "name", "kind", "line"), ix.symbols).groupBy("file", "caller").agg(F.count("*").alias("callees"))


HUB, START = "brinefall/core/runtime/dispatch.py", "emit_event"


@query(
    "SELECT node, hop, through FROM w3 WHERE hop > 0",
    "refs", "symbols", _BODIES, _CALLS, f"own AS (SELECT caller AS src, callee AS dst FROM calls c WHERE file = '{HUB}' AND EXISTS (SELECT 1 FROM symbols s WHERE s.file = c.file AND s.name = c.callee))",
    *_levels("own", f"'{START}'", 3),
)
def callees_of(ix):
    return G.callees_of(ix.once("refs", "file", "name", "kind", "line"), ix.symbols, HUB, START, 3)


_TRACE = "t AS (SELECT DISTINCT c.file || '#' || c.caller AS src, d.file || '#' || d.name AS dst FROM calls c JOIN (SELECT DISTINCT file, name FROM symbols WHERE file IS NOT NULL) d ON c.callee = d.name)"


@query("SELECT src, dst FROM t", "refs", "symbols", _BODIES, _CALLS, _TRACE)
def trace_edges(ix):
    return G.trace_edges(ix.once("refs", "file", "name", "kind", "line"), ix.symbols).distinct()


@query("SELECT node, hop, through FROM w4", "refs", "symbols", _BODIES, _CALLS, _TRACE, *_levels("t", f"'{HUB}#{START}'", 4))
def trace_levels(ix):
    seed = ix.spark.createDataFrame([(f"{HUB}#{START}",)], "node string")
    return G.reach(G.trace_edges(ix.once("refs", "file", "name", "kind", "line"), ix.symbols), seed, 4)


@query(
    "SELECT hop AS step, node FROM p",
    "refs", "symbols", _BODIES, _CALLS, _TRACE, *_levels("t", f"'{HUB}#{START}'", 4),
    f"""z AS (SELECT max(node) AS node FROM w4 WHERE hop = (SELECT max(hop) FROM w4))""",
    "p0 AS (SELECT w.* FROM w4 w JOIN z ON w.node = z.node)", "p1 AS (SELECT w.* FROM w4 w JOIN p0 ON w.node = p0.through)", "p2 AS (SELECT w.* FROM w4 w JOIN p1 ON w.node = p1.through)",
    "p3 AS (SELECT w.* FROM w4 w JOIN p2 ON w.node = p2.through)", "p4 AS (SELECT w.* FROM w4 w JOIN p3 ON w.node = p3.through)",
    "p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)",
)
def trace_call_chain(ix):
    """The way to the farthest symbol within four calls, the largest one of those."""
    edges = G.cut(G.trace_edges(ix.once("refs", "file", "name", "kind", "line"), ix.symbols))
    far = G.reach(edges, ix.spark.createDataFrame([(f"{HUB}#{START}",)], "node string"), 4).agg(F.max(F.struct("hop", "node"))["node"]).first()[0]
    return G.trace(edges, f"{HUB}#{START}", far, 4)


@query(
    "SELECT node, hop FROM w2", "edges",
    "b AS (SELECT src, dst FROM edges WHERE type = 'imports' AND src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM edges WHERE type = 'imports' AND src IS NOT NULL AND dst IS NOT NULL)",
    *_levels("b", f"'{TARGET}'", 2),
)
def graph_payload(ix):
    return G.neighbourhood(ix.once("edges", "src", "dst", "type").where("type = 'imports'"), TARGET, 2)


@query(
    """SELECT l.id, l.current_path AS path, l.tombstoned_at IS NOT NULL AS ghost, coalesce(d.n, 0) AS in_degree, s.staleness, coalesce(o.n, 0) AS open_leases FROM file_lifeline l
LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE type = 'imports' GROUP BY dst) d ON l.current_path = d.dst
LEFT JOIN (SELECT target, ['fresh', 'recovered', 'unknown', 'weakly_stale', 'strongly_stale', 'contradicted'][1 + max(CASE staleness WHEN 'fresh' THEN 0 WHEN 'recovered' THEN 1 WHEN 'weakly_stale' THEN 3 WHEN 'strongly_stale' THEN 4 WHEN 'contradicted' THEN 5 ELSE 2 END)] AS staleness FROM annotations GROUP BY target) s ON l.current_path = s.target
LEFT JOIN (SELECT lifeline_id, count(*) AS n FROM leases WHERE state = 'open' GROUP BY lifeline_id) o ON l.id = o.lifeline_id""",
    "edges", "annotations", "leases",
)
def lifeline_graph(ix):
    return G.lifeline_graph(ix.lifelines, ix.once("annotations", "target", "kind", "staleness", "severity"), ix.once("edges", "dst", "type"), ix.leases)


@query(
    f"SELECT DISTINCT a.id, a.target FROM annotations a JOIN (SELECT src AS n FROM edges WHERE dst = '{TARGET}' UNION SELECT dst FROM edges WHERE src = '{TARGET}') x ON a.target = x.n WHERE a.severity IN ('high', 'critical') AND (a.expires_at IS NULL OR a.expires_at > {AS_OF})",
    "annotations", "edges",
)
def blast_radius(ix):
    notes = ix.once("annotations", "target", "expires_at", "severity").where(F.col("severity").isin("high", "critical") & alive(AS_OF)).select("id", "target")
    return notes.join(G.neighbours(ix.once("edges", "src", "dst"), TARGET).withColumnRenamed("node", "target"), "target", "left_semi")


@query(
    "SELECT e.id, e.dst, CASE WHEN n.n > 1 THEN 'low' ELSE e.confidence END AS confidence FROM edges e LEFT JOIN (SELECT name, count(*) AS n FROM symbols GROUP BY name) n ON regexp_extract(e.dst, '#([^.#/!]*)', 1) = n.name WHERE e.type = 'extends' AND e.dst IS NOT NULL",
    "edges", "symbols",
)
def re_resolve_inheritance(ix):
    return G.ambiguous_inheritance(ix.once("edges", "dst", "type", "confidence"), ix.symbols)


@query("SELECT src, count(*) AS edges, count(*) FILTER (regexp_matches(dst, '^(module|builtin|binding):')) AS \"external\" FROM edges WHERE src IS NOT NULL GROUP BY src", "edges")
def external_share(ix):
    return G.external_share(ix.once("edges", "src", "dst"))


_TEST = "(regexp_matches('/' || lower(path), '/tests?/') OR starts_with(lower(regexp_extract(path, '[^/]*$')), 'test_') OR regexp_matches(lower(path), '_test\\.(py|go)$') OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\.(test|spec)\\.'))"


@query(
    """SELECT DISTINCT s.path, t.path AS test FROM s JOIN edges e ON e.dst = s.path AND e.type = 'imports' JOIN t ON e.src = t.path
UNION SELECT s.path, t.path FROM s JOIN t ON split_part(s.path, '/', 1) = split_part(t.path, '/', 1) AND regexp_extract(regexp_extract(s.path, '[^/]*$'), '^([^.]*)', 1) = regexp_replace(regexp_extract(regexp_extract(t.path, '[^/]*$'), '^([^.]*)', 1), '^test_|_test$', '', 'g')
  WHERE length(regexp_replace(regexp_extract(regexp_extract(t.path, '[^/]*$'), '^([^.]*)', 1), '^test_|_test$', '', 'g')) > 3""",
    "files", "edges", f"s AS (SELECT path FROM files WHERE NOT {_TEST})", f"t AS (SELECT path FROM files WHERE {_TEST})",
)
def guess_tests(ix):
    return G.guess_tests(ix.once("edges", "src", "dst", "type"), ix.files)


@query("SELECT dir, count(*) AS files FROM (SELECT unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/') || '/')) AS dir FROM files) GROUP BY dir", "files")
def directory_tree(ix):
    return G.directory_tree(ix.files)


@query(
    "SELECT caller_file, count(*) AS calls, count(*) FILTER (n = 0) AS unresolved, count(*) FILTER (n > 1) AS ambiguous FROM (SELECT c.file AS caller_file, c.caller, c.callee, count(d.file) AS n FROM calls c LEFT JOIN (SELECT DISTINCT file, name FROM symbols) d ON c.callee = d.name AND d.file <> c.file GROUP BY 1, 2, 3) GROUP BY 1",
    "refs", "symbols", _BODIES, "calls AS (SELECT DISTINCT b.file, b.names AS caller, r.name AS callee FROM refs r JOIN bodies b ON r.file = b.file AND r.line BETWEEN b.line AND b.end_line WHERE r.kind = 'call' AND r.name IS NOT NULL)",
)
def callgraph_warnings(ix):
    calls = cross_file_calls(ix.once("refs", "file", "name", "kind", "line"), ix.symbols)
    return calls.groupBy("caller_file").agg(F.count("*").alias("calls"), F.count_if(F.col("candidates") == 0).alias("unresolved"), F.count_if(F.col("candidates") > 1).alias("ambiguous"))
