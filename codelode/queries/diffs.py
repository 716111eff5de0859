"""Differences of snapshots and states over whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import diffs as D
from codelode.queries.common import registry

BASE, HEAD = "audit", "after-merge"
QUERIES, ORACLE, query = registry()
_SIDES = (
    f"b AS (SELECT DISTINCT file, name, kind, line, symbol_id FROM symbol_snapshots WHERE label = '{BASE}')",
    f"h AS (SELECT DISTINCT file, name, kind, line, symbol_id FROM symbol_snapshots WHERE label = '{HEAD}')",
)
_KEYS = (
    "d AS (SELECT file, name, kind, 'added' AS change FROM (SELECT file, name, kind FROM h EXCEPT SELECT file, name, kind FROM b) UNION ALL SELECT file, name, kind, 'removed' FROM (SELECT file, name, kind FROM b EXCEPT SELECT file, name, kind FROM h))",
)


def _sides(ix):
    rows = ix.raw("symbol_snapshots")
    return D.under_label(rows, BASE), D.under_label(rows, HEAD)


@query("SELECT file, name, kind, change FROM d", *_SIDES, *_KEYS)
def symbol_diff(ix):
    return D.key_diff(*_sides(ix), ["file", "name", "kind"])


@query(
    "SELECT name, kind, CASE WHEN l = 1 AND c = 1 THEN '1to1' WHEN l = 1 THEN 'split' WHEN c = 1 THEN 'merge' ELSE 'many-to-many' END AS shape, l AS from_places, c AS to_places FROM (SELECT name, kind, count(*) FILTER (change = 'removed') AS l, count(*) FILTER (change = 'added') AS c FROM d WHERE file IS NOT NULL GROUP BY name, kind) WHERE l > 0 AND c > 0",
    *_SIDES, *_KEYS,
)
def symbol_moves(ix):
    return D.moved_keys(*_sides(ix), ["name", "kind"], "file")


@query(
    """SELECT kind, name, CASE WHEN sum(x) = 0 THEN 'added' WHEN sum(y) = 0 THEN 'removed' WHEN bool_or(x <> y) THEN 'moved' ELSE 'unchanged' END AS status,
  count(*) FILTER (x = 0) AS added_places, count(*) FILTER (y = 0) AS removed_places, count(*) FILTER (x = 1 AND y = 1) AS kept_places
FROM (SELECT kind, name, file, max(x) AS x, max(y) AS y FROM (SELECT kind, name, file, 1 AS x, 0 AS y FROM b UNION ALL SELECT kind, name, file, 0, 1 FROM h) GROUP BY kind, name, file) GROUP BY kind, name""",
    *_SIDES,
)
def contract_diff(ix):
    """The form of a contract diff, on names of symbols: by (kind, name) with its set of files."""
    return D.site_diff(*_sides(ix), ["kind", "name"], "file")


@query("SELECT file, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed FROM d GROUP BY file", *_SIDES, *_KEYS)
def per_file_diff(ix):
    return D.churn(*_sides(ix), ["file", "name", "kind"])


@query("SELECT DISTINCT name FROM b WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM h WHERE name IS NOT NULL)", *_SIDES)
def removed_names(ix):
    return D.removed_names(*_sides(ix))


@query(
    """SELECT file, concat_ws('; ', CASE WHEN len(a) > 0 THEN '+' || array_to_string(a[1:5], ', ') || CASE WHEN len(a) > 5 THEN ' (+' || (len(a) - 5) || ' more)' ELSE '' END END, CASE WHEN len(r) > 0 THEN '-' || array_to_string(r[1:5], ', ') || CASE WHEN len(r) > 5 THEN ' (+' || (len(r) - 5) || ' more)' ELSE '' END END) AS text
FROM (SELECT file, coalesce(list(name ORDER BY name) FILTER (c = 'a'), []) AS a, coalesce(list(name ORDER BY name) FILTER (c = 'r'), []) AS r FROM (SELECT file, name, 'a' AS c FROM (SELECT file, name FROM h EXCEPT SELECT file, name FROM b) UNION ALL SELECT file, name, 'r' FROM (SELECT file, name FROM b EXCEPT SELECT file, name FROM h)) WHERE name IS NOT NULL GROUP BY file)""",
    *_SIDES,
)
def describe_delta(ix):
    return D.describe_delta(*_sides(ix))


@query(
    "SELECT coalesce(f.path, t.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM files f FULL JOIN (SELECT path, sha1(text) AS hash FROM file_texts) t ON f.path = t.path WHERE f.path IS NULL OR t.path IS NULL OR f.hash IS DISTINCT FROM t.hash",
    "files",
)
def discover_changes(ix):
    found = ix.texts.select("path", F.sha1(F.encode("text", "UTF-8")).alias("hash"))
    return D.listing_diff(ix.files.select("path", "hash"), found)


@query("SELECT label, file, name, kind, line FROM symbol_snapshots WHERE label = 'audit'")
def snapshot_rows(ix):
    return ix.raw("symbol_snapshots").where("label = 'audit'").select("label", "file", "name", "kind", "line")


@query("SELECT coalesce(max(label) FILTER (label = 'pre-index'), max_by(label, pos)) AS label FROM labels", "labels")
def default_snapshot(ix):
    return D.default_base(ix.labels)


@query(
    """SELECT name, list_sort(list_distinct([name, replace(name, '-', '_'), CASE WHEN contains(replace(name, '-', '_'), '_') THEN split_part(replace(name, '-', '_'), '_', 1) || array_to_string(list_transform(string_split(replace(name, '-', '_'), '_')[2:], lambda p: upper(p[1:1]) || lower(p[2:])), '') ELSE replace(name, '-', '_') END])) AS variants
FROM (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL)""",
    "symbols",
)
def name_variants(ix):
    return ix.symbols.where("name is not null").select("name").distinct().select("name", F.array_sort(D.name_variants(F.col("name"))).alias("variants"))


_USES = (
    "v AS (SELECT kind, name, unnest(list_distinct([name, replace(name, '-', '_'), CASE WHEN contains(replace(name, '-', '_'), '_') THEN split_part(replace(name, '-', '_'), '_', 1) || array_to_string(list_transform(string_split(replace(name, '-', '_'), '_')[2:], lambda p: upper(p[1:1]) || lower(p[2:])), '') ELSE name END])) AS x FROM (SELECT DISTINCT kind, name FROM d WHERE name IS NOT NULL AND change = '{0}'))",
    "n AS (SELECT name, count(*) AS n FROM refs GROUP BY name)",
)


@query("SELECT v.kind, v.name, sum(coalesce(n.n, 0))::BIGINT AS uses, sum(coalesce(n.n, 0)) = 0 AS orphan FROM v LEFT JOIN n ON v.x = n.name GROUP BY v.kind, v.name", *_SIDES, *_KEYS, "refs", _USES[0].format("added"), _USES[1])
def consumer_analysis(ix):
    added = D.key_diff(*_sides(ix), ["file", "name", "kind"]).where("change = 'added' and name is not null")
    return D.consumers(added, None, ix.once("refs", "file", "name", "kind", "line"))


@query("SELECT v.kind, v.name, sum(coalesce(n.n, 0))::BIGINT AS uses, sum(coalesce(n.n, 0)) = 0 AS orphan FROM v LEFT JOIN n ON v.x = n.name GROUP BY v.kind, v.name", *_SIDES, *_KEYS, "refs", _USES[0].format("removed"), _USES[1])
def dangling_analysis(ix):
    removed = D.key_diff(*_sides(ix), ["file", "name", "kind"]).where("change = 'removed' and name is not null")
    return D.consumers(removed, None, ix.once("refs", "file", "name", "kind", "line"), declaring=False)


@query(
    "SELECT CASE WHEN c = 'added' THEN 'consume_' || kind ELSE 'dangling_ref' END AS obligation, kind, name FROM (SELECT c, v.kind, v.name, sum(coalesce(n.n, 0)) AS uses FROM v LEFT JOIN n ON v.x = n.name GROUP BY c, v.kind, v.name) WHERE (c = 'added') = (uses = 0)",
    *_SIDES, *_KEYS, "refs",
    _USES[0].replace("SELECT kind, name, unnest", "SELECT c, kind, name, unnest").replace("SELECT DISTINCT kind, name FROM d WHERE name IS NOT NULL AND change = '{0}'", "SELECT DISTINCT change AS c, kind, name FROM d WHERE name IS NOT NULL"), _USES[1],
)
def project_obligations(ix):
    changes = D.cut(D.key_diff(*_sides(ix), ["file", "name", "kind"]).where("name is not null"))
    return D.obligations(D.consumers(changes.where("change = 'added'"), None, ix.once("refs", "file", "name", "kind", "line")), D.consumers(changes.where("change = 'removed'"), None, ix.once("refs", "file", "name", "kind", "line"), declaring=False))


@query(
    "SELECT coalesce(e.path, c.file) AS path, coalesce(e.n, 0) AS edits, coalesce(c.churn, 0) AS churn FROM (SELECT path, count(*) AS n FROM edits WHERE path IS NOT NULL GROUP BY path) e FULL JOIN (SELECT file, count(*) AS churn FROM d WHERE file IS NOT NULL GROUP BY file) c ON e.path = c.file",
    *_SIDES, *_KEYS, "edits",
)
def compute_changes(ix):
    edits = ix.edits.where("path is not null").groupBy("path").agg(F.count("*").alias("edits"))
    churn = D.churn(*_sides(ix), ["file", "name", "kind"]).where("file is not null").select(F.col("file").alias("path"), (F.col("added") + F.col("removed")).alias("churn"))
    return edits.join(churn, "path", "full").fillna(0)
