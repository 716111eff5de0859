"""Queries of the general problems over their whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.operators.change_feed import current_rows, fold_changes
from codelode.operators.hot_keys import heavy_keys, key_profile, once
from codelode.operators.intervals import periods_and_gaps
from codelode.operators.orphans import orphans, orphans_by_month
from codelode.operators.snapshot_diff import snapshot_changes
from codelode.plans.scratch import cut
from codelode.sources.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return snapshot_changes(table(spark, base, "symbol_snapshots"), table(spark, base, "snapshot_labels"))


def p1_summary(spark: SparkSession, base: str) -> DataFrame:
    return p1_found(spark, base).groupBy("label", "change_kind").agg(F.count("*").alias("records"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return current_rows(table(spark, base, "file_edits"))


def p2_tombstones(spark: SparkSession, base: str) -> DataFrame:
    return fold_changes(table(spark, base, "file_edits")).where("op = 'delete'").select("path", "edits")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    names = ("refs", "edges", "annotations", "file_event", "symbol_snapshots", "snapshot_labels", "files", "file_lifeline")
    return orphans(*(table(spark, base, t) for t in names))


def p4_by_month(spark: SparkSession, base: str) -> DataFrame:
    names = ("refs", "edges", "annotations", "file_event", "files")
    return orphans_by_month(cut(p4_found(spark, base)), *(table(spark, base, t) for t in names))


def _refs_once(spark: SparkSession, base: str) -> DataFrame:
    return once(table(spark, base, "refs"), "id", ("name", "file"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return heavy_keys(_refs_once(spark, base), ("name", "file")).select("field", "hot_key")


def p6_by_name(spark: SparkSession, base: str) -> DataFrame:
    return key_profile(_refs_once(spark, base), "name", "file", "name").withColumnRenamed("others", "files")


def p6_by_file(spark: SparkSession, base: str) -> DataFrame:
    return key_profile(_refs_once(spark, base), "file", "name", "file").withColumnRenamed("others", "names")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    spans = periods_and_gaps(table(spark, base, "edit_lease"), "lifeline_id", "opened_at", "expires_at", unit=0.25)
    return spans.select(F.col("entity").alias("lifeline_id"), "span", (F.col("lo") * 250).alias("start_ms"), (F.col("hi") * 250).alias("end_ms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_summary": p1_summary,
    "p2_found": p2_found,
    "p2_tombstones": p2_tombstones,
    "p4_found": p4_found,
    "p4_by_month": p4_by_month,
    "p6_found": p6_found,
    "p6_by_name": p6_by_name,
    "p6_by_file": p6_by_file,
    "p7_found": p7_found,
}

_P1 = """
WITH l AS (SELECT label, row_number() OVER (ORDER BY max(taken_at), label) AS pos FROM snapshot_labels
           WHERE label IS NOT NULL AND taken_at IS NOT NULL GROUP BY label),
r AS (SELECT DISTINCT l.pos, s.file, s.name, s.kind, s.line, s.symbol_id FROM symbol_snapshots s JOIN l ON s.label = l.label),
v AS (SELECT pos, file, name, kind, list(coalesce(CAST(line AS VARCHAR), '~') || '|' || coalesce(symbol_id, '~')
      ORDER BY coalesce(CAST(line AS VARCHAR), '~') || '|' || coalesce(symbol_id, '~')) AS vals FROM r GROUP BY pos, file, name, kind),
d AS (
  SELECT b.pos, b.file, b.name, b.kind, CASE WHEN a.pos IS NULL THEN 'added' ELSE 'changed' END AS change_kind
  FROM v b LEFT JOIN v a ON a.pos = b.pos - 1 AND a.file IS NOT DISTINCT FROM b.file
       AND a.name IS NOT DISTINCT FROM b.name AND a.kind IS NOT DISTINCT FROM b.kind
  WHERE b.pos > 1 AND (a.pos IS NULL OR a.vals <> b.vals)
  UNION ALL
  SELECT a.pos + 1, a.file, a.name, a.kind, 'removed'
  FROM v a LEFT JOIN v b ON b.pos = a.pos + 1 AND a.file IS NOT DISTINCT FROM b.file
       AND a.name IS NOT DISTINCT FROM b.name AND a.kind IS NOT DISTINCT FROM b.kind
  WHERE b.pos IS NULL AND a.pos < (SELECT max(pos) FROM l))
"""
_P2 = """
WITH e AS (SELECT path, prev_hash, new_hash, session_id, min(ts) AS t FROM file_edits WHERE path IS NOT NULL
           GROUP BY path, prev_hash, new_hash, session_id),
came AS (SELECT path, new_hash AS h, count(*) AS n, max(t) AS t FROM e GROUP BY path, new_hash),
gone AS (SELECT path, prev_hash AS h, count(*) AS n, min(t) AS t FROM e GROUP BY path, prev_hash),
-- the end of an open walk: reached once more than left
open AS (SELECT c.path, c.h FROM came c LEFT JOIN gone g ON c.path = g.path AND c.h IS NOT DISTINCT FROM g.h WHERE c.n > coalesce(g.n, 0)),
-- a closed walk ends where it began: without a file if it ever is without one, else by its times
closed AS (SELECT c.path, c.h, row_number() OVER (PARTITION BY c.path ORDER BY (c.h IS NULL) DESC, c.t - g.t DESC NULLS LAST, c.t DESC NULLS LAST, c.h DESC) AS rn
           FROM came c JOIN gone g ON c.path = g.path AND c.h IS NOT DISTINCT FROM g.h WHERE c.path NOT IN (SELECT path FROM open)),
k AS (SELECT path, h FROM open UNION ALL SELECT path, h FROM closed WHERE rn = 1)
"""
_P4 = """
WITH l AS (SELECT label, row_number() OVER (ORDER BY max(taken_at) DESC, label DESC) AS age FROM snapshot_labels
           WHERE label IS NOT NULL AND taken_at IS NOT NULL GROUP BY label),
s AS (SELECT s.file, s.name, min(l.age) AS age FROM symbol_snapshots s JOIN l ON s.label = l.label GROUP BY s.file, s.name),
sn AS (SELECT name, min(age) AS age FROM s WHERE name IS NOT NULL GROUP BY name),
sf AS (SELECT file || '#' || name AS sym, min(age) AS age FROM s WHERE file IS NOT NULL AND name IS NOT NULL GROUP BY file || '#' || name),
t AS (
  SELECT 'edges' AS src_table, id, dst AS target FROM edges WHERE dst IS NOT NULL
  UNION SELECT 'annotations', id, target FROM annotations WHERE target IS NOT NULL),
k AS (
  SELECT src_table, id, CASE WHEN contains(target, '#') THEN 'symbol' WHEN ends_with(target, '/') THEN 'dir' ELSE 'path' END AS space,
         CASE WHEN contains(target, '#') THEN regexp_replace(target, '[.#/!]$', '') ELSE target END AS k
  FROM t WHERE NOT regexp_matches(target, '^(module|builtin|binding):') AND target <> '@project'),
f AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL),
d AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') || '/' AS dir
      FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM f)),
g AS (SELECT DISTINCT current_path FROM file_lifeline WHERE tombstoned_at IS NOT NULL AND current_path IS NOT NULL),
found AS (
  SELECT DISTINCT 'refs' AS src_table, r.id AS ref_id, CASE WHEN sn.name IS NULL THEN 'missing' ELSE 'deleted' END AS state
  FROM refs r LEFT JOIN sn ON r.name = sn.name WHERE r.name IS NOT NULL AND coalesce(sn.age, 99) > 1
  UNION
  SELECT k.src_table, k.id, CASE WHEN sf.sym IS NULL THEN 'missing' ELSE 'deleted' END
  FROM k LEFT JOIN sf ON k.k = sf.sym WHERE k.space = 'symbol' AND coalesce(sf.age, 99) > 1
  UNION
  SELECT k.src_table, k.id, 'missing' FROM k LEFT JOIN d ON k.k = d.dir WHERE k.space = 'dir' AND d.dir IS NULL
  UNION
  SELECT k.src_table, k.id, CASE WHEN g.current_path IS NULL THEN 'missing' ELSE 'deleted' END
  FROM k LEFT JOIN f ON k.k = f.path LEFT JOIN g ON k.k = g.current_path WHERE k.space = 'path' AND f.path IS NULL
  UNION
  SELECT 'file_event', e.id, CASE WHEN x.id IS NULL THEN 'missing' WHEN e."at" > x.tombstoned_at THEN 'deleted' ELSE 'late' END
  FROM file_event e LEFT JOIN file_lifeline x ON e.lifeline_id = x.id
  WHERE e.lifeline_id IS NOT NULL AND (x.id IS NULL OR e."at" > x.tombstoned_at OR e."at" < x.created_at))
"""
_P6 = "WITH r AS (SELECT id, max(name) AS name, max(file) AS file FROM refs WHERE id IS NOT NULL GROUP BY id)"

ORACLE: dict[str, str] = {
    "p1_found": _P1 + "SELECT l.label, d.file, d.name, d.kind, d.change_kind FROM d JOIN l ON d.pos = l.pos",
    "p1_summary": _P1 + "SELECT l.label, d.change_kind, count(*) AS records FROM d JOIN l ON d.pos = l.pos GROUP BY l.label, d.change_kind",
    "p2_found": _P2 + "SELECT path, h AS hash FROM k WHERE h IS NOT NULL",
    "p2_tombstones": _P2 + "SELECT k.path, count(*) AS edits FROM k JOIN e ON k.path = e.path WHERE k.h IS NULL GROUP BY k.path",
    "p4_found": _P4 + "SELECT src_table, ref_id, state FROM found",
    "p4_by_month": _P4
    + """, seen AS (SELECT path, max(indexed_at) AS t FROM files GROUP BY path),
own AS (
  SELECT DISTINCT 'refs' AS src_table, r.id, s.t FROM refs r LEFT JOIN seen s ON r.file = s.path
  UNION SELECT 'edges', e.id, s.t FROM edges e LEFT JOIN seen s ON regexp_extract(e.src, '^[^#]*') = s.path
  UNION SELECT 'annotations', id, created_at FROM annotations
  UNION SELECT 'file_event', id, "at" FROM file_event)
SELECT o.src_table, strftime(make_timestamp(CAST(floor(o.t) AS BIGINT) * 1000000), '%Y-%m') AS month, f.state, count(*) AS orphans
FROM found f JOIN own o ON f.src_table = o.src_table AND f.ref_id = o.id GROUP BY 1, 2, 3""",
    "p6_found": _P6
    + """, c AS (SELECT 'name' AS field, name AS hot_key, count(*) AS n FROM r WHERE name IS NOT NULL GROUP BY name
  UNION ALL SELECT 'file', file, count(*) FROM r WHERE file IS NOT NULL GROUP BY file)
SELECT field, hot_key FROM (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM c) WHERE n * 100 >= total""",
    "p6_by_name": _P6 + 'SELECT name, count(*) AS "rows", count(DISTINCT file) AS files FROM r WHERE name IS NOT NULL GROUP BY name',
    "p6_by_file": _P6 + 'SELECT file, count(*) AS "rows", count(DISTINCT name) AS names FROM r WHERE file IS NOT NULL GROUP BY file',
    "p7_found": """
WITH i AS (SELECT DISTINCT lifeline_id, CAST(opened_at * 1000 AS BIGINT) AS s, CAST(expires_at * 1000 AS BIGINT) AS e FROM edit_lease
           WHERE lifeline_id IS NOT NULL AND expires_at > opened_at),
m AS (SELECT *, max(e) OVER (PARTITION BY lifeline_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY lifeline_id ORDER BY s, e) AS island FROM m),
c AS (SELECT lifeline_id, island, min(s) AS s, max(e) AS e FROM g GROUP BY lifeline_id, island)
SELECT lifeline_id, 'covered' AS span, s AS start_ms, e AS end_ms FROM c
UNION ALL
SELECT lifeline_id, 'gap', p, s FROM m WHERE s > p""",
}
