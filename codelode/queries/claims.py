"""Claims and integrity over whole tables, and the SQL that says what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import claims as C
from codelode.operators import integrity as I
from codelode.plans.scratch import cut
from codelode.queries.common import AS_OF, registry

QUERIES, ORACLE, query = registry()
_EXT = C.EXTENSIONS
_NOTE_CLAIMS = """nc AS (SELECT id, id || '/' || pos AS claim, e.subject AS subject, e.predicate AS predicate, e.object AS object, coalesce(e.truth_class, 'INFERENCE') AS truth_class, coalesce(e.confidence, 0.7) AS confidence
  FROM (SELECT id, unnest(range(0, len(evidence))) AS pos, unnest(evidence) AS e FROM annotations) WHERE e.predicate <> '')"""
_RESOLVED = (
    "ends AS (SELECT path, unnest(list_transform(range(2, len(string_split(path, '/')) + 1), lambda i: array_to_string(list_slice(string_split(path, '/'), i, NULL), '/'))) AS f FROM files)".replace("list_slice(string_split(path, '/'), i, NULL)", "string_split(path, '/')[i:]"),
    "res AS (SELECT a.f AS file, CASE WHEN bool_or(x.path IS NOT NULL) THEN a.f WHEN count(n.path) = 1 THEN min(n.path) END AS path, CASE WHEN bool_or(x.path IS NOT NULL) THEN 1 ELSE count(n.path) END AS matches FROM asked a LEFT JOIN files x ON a.f = x.path LEFT JOIN ends n ON a.f = n.f GROUP BY a.f)",
)
_TEXTS = "t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _texts(ix):
    return ix.raw("documents").where("text is not null").select("doc_id", "text")


@query(
    f"""SELECT DISTINCT doc_id, regexp_extract(m, '^(.*):[0-9]+$', 1) AS path, CAST(regexp_extract(m, ':([0-9]+)$', 1) AS INTEGER) AS line
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b[\\w./\\-]+\\.(?:{_EXT}):\\d+\\b')) AS m FROM t)""".replace("(?i)", ""),
    _TEXTS,
)
def cited_lines(ix):
    return C.cited_lines(_texts(ix), "doc_id", "text")


@query(
    f"SELECT c.doc_id, c.path, c.line, CASE WHEN r.matches > 1 THEN 'UNCHECKABLE' WHEN l.lines IS NULL OR c.line > l.lines OR c.line < 1 THEN 'REFUTED' ELSE 'VERIFIED' END AS verdict FROM c LEFT JOIN res r ON c.path = r.file LEFT JOIN l ON r.path = l.path",
    "files", _TEXTS,
    f"c AS (SELECT DISTINCT doc_id, regexp_extract(m, '^(.*):[0-9]+$', 1) AS path, CAST(regexp_extract(m, ':([0-9]+)$', 1) AS INTEGER) AS line FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[\\w./\\-]+\\.(?:{_EXT}):\\d+\\b')) AS m FROM t))",
    "asked AS (SELECT DISTINCT path AS f FROM c)", *_RESOLVED,
    "l AS (SELECT path, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS lines FROM file_texts WHERE text IS NOT NULL)",
)
def path_line_check(ix):
    return C.check_lines(C.cited_lines(_texts(ix), "doc_id", "text"), ix.texts, ix.files)


@query("SELECT id, claim, subject, predicate, object, truth_class, confidence FROM nc", "annotations", _NOTE_CLAIMS)
def claims_from_evidence(ix):
    return C.note_claims(ix.once("annotations", "evidence"))


@query(
    "SELECT claim, CASE WHEN length(a) > 0 THEN b ELSE place END AS file, CASE WHEN length(a) > 0 THEN CAST(a AS INTEGER) ELSE -1 END AS line FROM (SELECT claim, place, regexp_extract(place, '^.+:([0-9]+)$', 1) AS a, regexp_extract(place, '^(.+):[0-9]+$', 1) AS b FROM (SELECT claim, object || CASE WHEN confidence > 0.6 THEN ':12' ELSE '' END AS place FROM nc WHERE object IS NOT NULL))",
    "annotations", _NOTE_CLAIMS,
)
def location_parse(ix):
    rows = C.note_claims(ix.once("annotations", "evidence")).where("object is not null").select("claim", F.concat("object", F.when(F.col("confidence") > 0.6, ":12").otherwise("")).alias("place"))
    return rows.select("claim", C.location("place").alias("x")).select("claim", "x.file", F.coalesce("x.line", F.lit(-1)).alias("line"))


_VERDICTS = (
    "asked AS (SELECT DISTINCT object AS f FROM nc WHERE object IS NOT NULL)", *_RESOLVED,
    """v AS (SELECT nc.*, CASE WHEN object IS NULL OR r.matches > 1 THEN 'UNCHECKABLE'
  WHEN predicate IN ('exists', 'defined_at', 'exported-from') THEN CASE WHEN EXISTS (SELECT 1 FROM symbols s WHERE s.name = nc.subject AND s.file = r.path) THEN 'VERIFIED' ELSE 'REFUTED' END
  WHEN predicate = 'called_by' THEN CASE WHEN EXISTS (SELECT 1 FROM refs s WHERE s.name = nc.subject AND s.file = r.path) THEN 'VERIFIED' ELSE 'REFUTED' END ELSE 'UNCHECKABLE' END AS verdict
  FROM nc LEFT JOIN res r ON nc.object = r.file)""",
)
_STATUS = """st AS (SELECT id, CASE WHEN count(*) FILTER (verdict = 'REFUTED' AND truth_class = 'FACT') > 0 THEN 'contradicted' WHEN count(*) FILTER (verdict = 'REFUTED') > 0 THEN 'strongly_stale' WHEN count(*) FILTER (verdict = 'MOVED') > 0 THEN 'weakly_stale'
  WHEN count(*) FILTER (verdict = 'VERIFIED') = count(*) THEN 'fresh' WHEN count(*) FILTER (verdict = 'UNCHECKABLE') = count(*) THEN 'unknown' ELSE 'weakly_stale' END AS status,
  CASE WHEN sum(confidence) > 0 THEN round(sum(confidence * CASE verdict WHEN 'VERIFIED' THEN 1.0 WHEN 'UNCHECKABLE' THEN 0.5 ELSE 0.0 END) / sum(confidence), 4) END AS confidence,
  count(*) FILTER (verdict = 'VERIFIED') AS verified, count(*) FILTER (verdict = 'REFUTED') AS refuted, count(*) FILTER (verdict = 'UNCHECKABLE') AS uncheckable FROM v GROUP BY id)"""


def _verdicts(ix):
    claims = C.note_claims(ix.once("annotations", "evidence"))
    return claims.join(C.verify_claims(claims, ix.symbols, ix.once("refs", "name", "file"), ix.once("edges", "src", "dst", "type"), ix.files), "claim")


@query("SELECT claim, verdict FROM v", "annotations", "files", "symbols", "refs", _NOTE_CLAIMS, *_VERDICTS)
def verify_claims(ix):
    return _verdicts(ix).select("claim", "verdict")


@query("SELECT id, status, confidence, verified, refuted, uncheckable FROM st", "annotations", "files", "symbols", "refs", _NOTE_CLAIMS, *_VERDICTS, _STATUS)
def verify_note(ix):
    return C.note_status(_verdicts(ix))


@query("SELECT a.target, CASE WHEN bool_or(v.verdict = 'REFUTED') THEN 'REFUTED' WHEN bool_or(v.verdict = 'UNCHECKABLE') THEN 'AMBIGUOUS' ELSE 'PROVED' END AS status FROM annotations a JOIN v ON a.id = v.id WHERE a.target IS NOT NULL GROUP BY a.target", "annotations", "files", "symbols", "refs", _NOTE_CLAIMS, *_VERDICTS)
def status_for_target(ix):
    return I.target_status(ix.once("annotations", "target").where("target is not null").select("id", "target").join(_verdicts(ix).select("id", "verdict"), "id"))


@query(
    "SELECT 'e' || e.id AS claim, CASE WHEN x.n THEN 'VERIFIED' ELSE 'REFUTED' END AS verdict FROM edges e LEFT JOIN (SELECT DISTINCT src, dst, true AS n FROM edges WHERE type = 'reexport_star') x ON e.src = x.src AND e.dst = x.dst WHERE e.type IN ('reexport_star', 'pair_inspect') AND e.dst IS NOT NULL AND e.src IS NOT NULL",
    "edges",
)
def reexported_via(ix):
    claims = ix.once("edges", "src", "dst", "type").where("type in ('reexport_star', 'pair_inspect') and dst is not null and src is not null").select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("claim"), F.col("dst").alias("subject"), F.col("src").alias("object"))
    return C.verify_edge(claims, ix.once("edges", "src", "dst", "type"), "reexport_star").select("claim", "verdict")


@query(
    "SELECT 'e' || e.id AS claim, CASE WHEN x.n THEN 'VERIFIED' WHEN b.src IS NOT NULL THEN 'UNCHECKABLE' ELSE 'REFUTED' END AS verdict FROM edges e LEFT JOIN (SELECT DISTINCT src, dst, true AS n FROM edges WHERE type = 'imports') x ON e.src = x.src AND e.dst = x.dst "
    "LEFT JOIN (SELECT DISTINCT src FROM edges WHERE type = 'reexport_star') b ON e.src = b.src WHERE e.type IN ('imports', 'pair_inspect') AND e.dst IS NOT NULL AND e.src IS NOT NULL",
    "edges",
)
def reverse_dependency_of(ix):
    claims = ix.once("edges", "src", "dst", "type").where("type in ('imports', 'pair_inspect') and dst is not null and src is not null").select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("claim"), F.col("dst").alias("subject"), F.col("src").alias("object"))
    return C.verify_edge(claims, ix.once("edges", "src", "dst", "type"), "imports").select("claim", "verdict")


@query(
    """SELECT id AS claim, CASE WHEN bool_or(s.line = p.line) THEN 'VERIFIED' WHEN count(s.name) > 0 THEN 'MOVED' ELSE 'REFUTED' END AS verdict
FROM p LEFT JOIN symbols s ON s.name = p.name AND s.file = p.file GROUP BY id""",
    "symbols",
    "p AS (SELECT DISTINCT label || '/' || file || '/' || name || '/' || line AS id, name, file, line FROM symbol_snapshots WHERE label = 'audit' AND name IS NOT NULL AND file IN (SELECT path FROM main.files) AND line IS NOT NULL)",
)
def defined_at(ix):
    """Places of an earlier snapshot as claims against the current symbols."""
    old = ix.raw("symbol_snapshots").where("label = 'audit' and name is not null and line is not null").join(ix.files.select(F.col("path").alias("file")), "file", "left_semi")
    claims = old.select(F.concat_ws("/", "label", "file", "name", F.col("line").cast("string")).alias("claim"), F.col("name").alias("subject"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("object")).distinct()
    return C.verify_defined_at(claims, ix.symbols, ix.files).select("claim", "verdict")


@query("SELECT sha1(concat_ws('|', subject, predicate, object)) AS triple, count(*) AS claims FROM nc GROUP BY 1", "annotations", _NOTE_CLAIMS)
def triple_hash(ix):
    return C.note_claims(ix.once("annotations", "evidence")).groupBy(C.triple_hash(F.col("subject"), F.col("predicate"), F.col("object")).alias("triple")).agg(F.count("*").alias("claims"))


@query("SELECT DISTINCT claim FROM nc WHERE truth_class <> 'FACT' AND sha1(concat_ws('|', subject, predicate, object)) NOT IN (SELECT sha1(concat_ws('|', subject, predicate, object)) FROM nc WHERE truth_class = 'FACT')", "annotations", _NOTE_CLAIMS)
def uncaptured_claims(ix):
    claims = C.note_claims(ix.once("annotations", "evidence"))
    return C.uncaptured(claims.where("truth_class <> 'FACT'"), claims.where("truth_class = 'FACT'")).select("claim").distinct()


@query("SELECT name, count(*) AS callers, sha1(string_agg(file, chr(10) ORDER BY file)) AS callers_hash FROM (SELECT DISTINCT name, file FROM refs WHERE name IS NOT NULL AND file IS NOT NULL) GROUP BY name", "refs")
def callers_hash(ix):
    return I.callers_hash(ix.once("refs", "file", "name"))


_FP = (
    "p AS (SELECT target, CASE WHEN contains(target, '#') THEN nullif(split_part(target, '#', 1), '') WHEN contains(regexp_extract(target, '[^/]*$'), '.') AND NOT starts_with(target, '$') THEN target END AS file, CASE WHEN contains(target, '#') THEN nullif(regexp_extract(target, '#([^.#/!]*)', 1), '') END AS name FROM (SELECT DISTINCT target FROM annotations WHERE target IS NOT NULL))",
    "ch AS (SELECT name, sha1(string_agg(file, chr(10) ORDER BY file)) AS h FROM (SELECT DISTINCT name, file FROM refs WHERE name IS NOT NULL AND file IS NOT NULL) GROUP BY name)",
    "fp AS (SELECT p.target, f.hash AS file_hash, ch.h AS callers_hash FROM p LEFT JOIN files f ON p.file = f.path LEFT JOIN ch ON p.name = ch.name)",
)


@query("SELECT target, file_hash, callers_hash FROM fp", "annotations", "files", "refs", *_FP)
def fingerprint(ix):
    return I.fingerprints(ix.once("annotations", "target", "kind", "confidence", "confidence_base", "fingerprint", "staleness"), ix.files, ix.once("refs", "file", "name", "kind", "confidence"))


_REVALIDATED = """rv AS (SELECT id, staleness AS previous, base, CASE WHEN kind = 'refute' AND staleness = 'contradicted' THEN 'contradicted' ELSE
    ['fresh', 'recovered', 'unknown', 'weakly_stale', 'strongly_stale', 'contradicted'][1 + greatest(CASE l WHEN 'fresh' THEN 0 WHEN 'recovered' THEN 1 WHEN 'unknown' THEN 2 WHEN 'weakly_stale' THEN 3 ELSE 4 END, CASE said WHEN 'weakly_stale' THEN 3 WHEN 'strongly_stale' THEN 4 WHEN 'contradicted' THEN 5 ELSE 0 END)] END AS staleness
  FROM (SELECT *, CASE WHEN fingerprint IS NULL THEN 'unknown' WHEN d = 0 THEN CASE WHEN staleness IN ('weakly_stale', 'strongly_stale', 'contradicted') THEN 'recovered' ELSE 'fresh' END WHEN d = 1 THEN 'weakly_stale' ELSE 'strongly_stale' END AS l
    FROM (SELECT a.id, a.kind, a.staleness, a.fingerprint, coalesce(a.confidence_base, a.confidence) AS base, st.status AS said,
      CASE WHEN a.fingerprint.file_hash IS NOT NULL AND a.fingerprint.file_hash IS DISTINCT FROM fp.file_hash THEN 1 ELSE 0 END + CASE WHEN a.fingerprint.callers_hash IS NOT NULL AND a.fingerprint.callers_hash IS DISTINCT FROM fp.callers_hash THEN 1 ELSE 0 END AS d
      FROM annotations a LEFT JOIN fp ON a.target = fp.target LEFT JOIN st ON a.id = st.id)))"""


@query(
    "SELECT id, previous, staleness, base * CASE staleness WHEN 'unknown' THEN 0.75 WHEN 'weakly_stale' THEN 0.5 WHEN 'strongly_stale' THEN 0.25 WHEN 'contradicted' THEN 0.0 ELSE 1.0 END AS confidence FROM rv",
    "annotations", "files", "symbols", "refs", *_FP, _NOTE_CLAIMS, *_VERDICTS, _STATUS, _REVALIDATED,
)
def revalidate_annotation(ix):
    status = cut(C.note_status(_verdicts(ix)).select("id", "status"))
    notes = ix.once("annotations", "target", "kind", "confidence", "confidence_base", "fingerprint", "staleness")
    return I.revalidate(notes, I.fingerprints(ix.once("annotations", "target"), ix.files, ix.once("refs", "name", "file")), status)


@query(
    "SELECT id, CASE WHEN s AND NOT u THEN 'safe' WHEN u AND NOT s THEN 'unsafe' END AS polarity FROM (SELECT id, regexp_matches(lower(coalesce(body, '')), 'safe|no bug|no vulnerability|verified-safe|not exploitable|cannot be exploited|benign') AS s, regexp_matches(lower(coalesce(body, '')), 'bug|unsafe|vulnerability|exploit|crash|memory corruption|injection|insecure') AS u FROM annotations)",
    "annotations",
)
def polarity(ix):
    return ix.once("annotations", "body").select("id", I.polarity(F.col("body")).alias("polarity"))


@query("SELECT path FROM file_texts WHERE regexp_matches(text, '\\bBUG\\b|\\bFIXME\\b|\\bSECURITY\\b|\\bXXX\\b|# ?TODO:?\\s*(fix|security|insecure)')")
def code_markers(ix):
    return I.code_polarity(ix.texts).select("path")


_CONFLICT = "SELECT target, '{2}' AS severity, '{0}/{1}' AS kinds, count(*) AS notes FROM annotations WHERE kind IN ('{0}', '{1}') AND target IS NOT NULL AND (expires_at IS NULL OR expires_at > {3}) GROUP BY target HAVING count(DISTINCT kind) = 2"


@query(" UNION ALL ".join(_CONFLICT.format(a, b, s, AS_OF) for a, b, s in I.KIND_CONFLICTS), "annotations")
def kind_conflicts(ix):
    return I.kind_conflicts(ix.once("annotations", "target", "kind", "expires_at", "severity"), AS_OF)


@query(f"SELECT a.id, a.target, p.file FROM annotations a JOIN p ON a.target = p.target WHERE p.file IS NOT NULL AND NOT ends_with(p.file, '/') AND p.file NOT IN (SELECT path FROM files) AND (a.expires_at IS NULL OR a.expires_at > {AS_OF})", "annotations", "files", _FP[0])
def deleted_targets(ix):
    return I.deleted_targets(ix.once("annotations", "target", "expires_at"), ix.files, AS_OF)


@query(
    f"""SELECT a.id, 'safe' AS note, 'unsafe' AS code FROM annotations a JOIN p ON a.target = p.target JOIN file_texts t ON p.file = t.path WHERE (a.expires_at IS NULL OR a.expires_at > {AS_OF}) AND regexp_matches(t.text, '\\bBUG\\b|\\bFIXME\\b|\\bSECURITY\\b|\\bXXX\\b|# ?TODO:?\\s*(fix|security|insecure)')
AND coalesce(CASE WHEN regexp_matches(lower(coalesce(body, '')), 'safe|no bug|no vulnerability|verified-safe|not exploitable|cannot be exploited|benign') THEN CASE WHEN NOT regexp_matches(lower(body), 'bug|unsafe|vulnerability|exploit|crash|memory corruption|injection|insecure') THEN 'safe' END WHEN regexp_matches(lower(body), 'bug|unsafe|vulnerability|exploit|crash|memory corruption|injection|insecure') THEN 'unsafe' END,
  CASE kind WHEN 'verified-safe' THEN 'safe' WHEN 'refute' THEN 'unsafe' WHEN 'risk' THEN 'unsafe' WHEN 'documented-footgun' THEN 'unsafe' END) = 'safe'""",
    "annotations", _FP[0],
)
def tier_contradictions(ix):
    return I.tier_contradictions(ix.once("annotations", "target", "kind", "body", "expires_at"), ix.texts, AS_OF)


@query("SELECT p.target, s.n AS files, CASE WHEN s.n >= 3 THEN 'high' ELSE 'medium' END AS severity FROM p JOIN (SELECT name, count(DISTINCT file) AS n FROM symbols WHERE file IS NOT NULL GROUP BY name HAVING count(DISTINCT file) > 1) s ON p.name = s.name WHERE contains(p.target, '#')", "annotations", "symbols", _FP[0])
def ambiguity_for_target(ix):
    return I.ambiguous_targets(ix.once("annotations", "target", "severity"), ix.symbols)


@query("SELECT f.path, CASE WHEN t.path IS NULL THEN 'file-missing' ELSE 'hash-mismatch' END AS reason FROM files f LEFT JOIN (SELECT path, sha1(text) AS h FROM file_texts WHERE text IS NOT NULL) t ON f.path = t.path WHERE t.path IS NULL OR f.hash IS DISTINCT FROM t.h", "files")
def check_paths(ix):
    return I.check_paths(ix.files, ix.texts.where("text is not null").select("path", F.sha1(F.encode("text", "UTF-8")).alias("hash")))


@query(
    """SELECT id, cited, cited IN (SELECT name FROM symbols WHERE name IS NOT NULL UNION SELECT path FROM files) AS found FROM (
  SELECT DISTINCT id, cited FROM (SELECT id, unnest(regexp_extract_all(body, '`([^`\\s]+)`', 1)) AS cited FROM annotations UNION ALL SELECT id, unnest(regexp_extract_all(body, '([A-Za-z_][\\w.-]*(?:/[\\w.-]+)+\\.\\w+)', 1)) FROM annotations)
  WHERE contains(cited, '/') OR (regexp_matches(cited, '^[A-Za-z_$][\\w$]*$') AND NOT regexp_matches(cited, '^[A-Z0-9_]+$')))""",
    "annotations", "symbols", "files",
)
def verify_note_body(ix):
    return I.body_citations(ix.once("annotations", "body"), ix.symbols, ix.files)


@query(f"SELECT id, target, staleness FROM annotations WHERE staleness IN ('weakly_stale', 'strongly_stale') AND (expires_at IS NULL OR expires_at > {AS_OF})", "annotations")
def stale_notes(ix):
    return ix.once("annotations", "target", "expires_at", "staleness").where(F.col("staleness").isin("weakly_stale", "strongly_stale") & I.alive(AS_OF)).select("id", "target", "staleness")


@query(f"SELECT id, target FROM annotations WHERE target <> '' AND NOT regexp_matches(target, '[/#:]') AND NOT starts_with(target, '@') AND target NOT IN (SELECT name FROM symbols WHERE name IS NOT NULL) AND (expires_at IS NULL OR expires_at > {AS_OF})", "annotations", "symbols")
def renamed_notes(ix):
    bare = ix.once("annotations", "target", "expires_at").where(I.alive(AS_OF) & (F.col("target") != "") & ~F.col("target").rlike("[/#:]|^@")).select("id", "target")
    return bare.join(ix.symbols.where("name is not null").select(F.col("name").alias("target")).distinct(), "target", "left_anti").select("id", "target")


@query(
    """SELECT 'stale_files' AS "check", round(100.0 * count(*) FILTER (stale = 1) / count(*), 1)::DOUBLE AS value FROM files UNION ALL SELECT 'no_parser', round(100.0 * count(*) FILTER (coalesce(parser, 'none') = 'none') / count(*), 1) FROM files
UNION ALL SELECT 'oversize', round(100.0 * count(*) FILTER (size > 3000000) / count(*), 1) FROM files UNION ALL SELECT 'dangling_edges', round(100.0 * count(*) FILTER (dst IS NULL) / count(*), 1) FROM edges""",
    "files", "edges",
)
def doctor(ix):
    return I.health(ix.files, ix.once("refs", "name", "target_symbol_id"), ix.once("edges", "dst"), ix.symbols).where("check not in ('artifact_files', 'ref_binding')").select("check", "value")
