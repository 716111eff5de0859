"""Scores, findings and reports that put the other operators together, and the small text rules they use."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.paths import artifact_class, parse_target
from codelode.operators.extract import occurrences
from codelode.operators.integrity import DECAY, ambiguous_targets, deleted_targets, kind_conflicts, tier_contradictions
from codelode.operators.lookups import alive

# Weights and question shapes that results must equal.
WEIGHTS = {
    "retrieval_confidence": 0.25, "note_freshness": 0.22, "contradiction_penalty": 0.17, "ambiguity_penalty": 0.13, "structural_coverage": 0.07,
    "macro_gap_penalty": 0.10, "binding_gap_penalty": 0.03, "module_resolution_penalty": 0.02, "stale_recovery_penalty": 0.01,
}
SHAPES = (
    (r"\b(what (?:is|does) (?:this|the) (?:repo|project|codebase))|\b(repo overview|project overview|orient me)", "project_overview"),
    (r"\b(what do we know|what(?:'s| is) (?:in )?memory|prior (?:notes|conclusions))", "memory_recall"),
    (r"\b(what('s| has| have we)? changed|what was edited|what's new|latest edits?|(?:since|last) session)", "changes"),
    (r"\b(who uses|who calls|who imports?|who depends on|consumers? of|callers? of)\b", "who_uses"),
    (r"\b(where (?:is|are) .+ defined|where .+ (?:is )?declared)", "where_defined"),
    (r"\b(where (?:is|are) .+ (?:read|set|used))", "where_used"),
    (r"\b(what does .+ do|what is .+|explain .+|how does .+ work|tell me about .+)", "explain"),
    (r"\b(safe to (?:delete|remove)|can (?:i|we) (?:delete|remove)|blast radius)", "blast_radius"),
    (r"\b(verify .+|is .+ still (?:true|valid|correct))", "verify"),
)
# End of fixed values.


def age(seconds: Column) -> Column:
    """`just now`, minutes, hours or days ago; `never` for null."""
    whole = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds.isNull(), "never").when(seconds < 60, "just now").when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def cited_line(body: Column) -> Column:
    """The first `:N` of a text, null without one or for 0."""
    return F.nullif(F.regexp_extract(body, r":(\d{1,9})\b", 1), F.lit("")).cast("int")


def is_identifier_citation(token: Column) -> Column:
    return token.rlike(r"^[A-Za-z_$][\w$]*$") & ~token.rlike(r"^[A-Z0-9_]+$")


def is_field_name(name: Column) -> Column:
    return F.length(name).between(2, 40) & name.rlike(r"^[A-Za-z_][A-Za-z0-9_\-]*$")


def normal_path(path: Column) -> Column:
    """With slashes, without a leading `./`, and without `.` and `..` segments where they can be resolved."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    # `..` takes away the segment before it, unless that is `..` itself
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    joined = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))
    return F.when(path.isNull() | (path == ""), path).when(joined == "", ".").otherwise(joined)


def clean_body(body: Column, most: int = 16_000) -> Column:
    """Line ends as \\n, without control characters, at most so many characters."""
    text = F.regexp_replace(F.regexp_replace(body, r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n[truncated]"))).otherwise(text)


def question_shape(question: Column) -> Column:
    """The first shape whose pattern is in a question; unclassified without one."""
    out = F.when(question.rlike(r"(?i)[<{]\s*(?:name|target|symbol|file|subject|query|term)\s*[>}]"), "placeholder")
    for pattern, shape in SHAPES:
        out = out.when(question.rlike("(?i)" + pattern), shape)
    return out.otherwise("unclassified")


def question_subject(question: Column) -> Column:
    """What a question is about: a path, else a name in backticks or quotes, else a name in camel case or with underscores."""
    first = lambda pattern: F.nullif(F.regexp_extract(question, pattern, 1), F.lit(""))
    return F.coalesce(first(r"([\w.-]+(?:/[\w.-]+)+\.\w+)"), first(r"`([^`]+)`"), first(r"['\"]([\w./#-]+)['\"]"), first(r"\b([a-z][a-z0-9]*(?:[A-Z]|_[a-z])\w*)\b"))


def import_class(path: Column, spec: Column, stdlib: tuple[str, ...]) -> Column:
    root = F.substring_index(spec, ".", 1)
    return F.when(spec.rlike(r"^[./]"), "unresolved_repo_relative").when(path.endswith(".py") & root.isin(*stdlib), "stdlib").otherwise("external")


def consumer_tag(line: Column) -> Column:
    s = F.trim(line)
    return F.when(s.rlike(r"^case\s+['\"]"), "switch-case").when(s.rlike(r"^switch\s*\("), "switch-head").when(s.rlike(r"^(if[ (]|else if)") | F.contains(s, F.lit("? ")), "conditional").otherwise("read")


def package_entries(texts: DataFrame) -> DataFrame:
    """(path, kind, name, value) of package.json texts: entrypoints, scripts and dependencies; texts that aren't JSON objects have none."""
    deps = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    schema = "main string, module string, scripts map<string, string>, " + ", ".join(f"{d} map<string, string>" for d in deps)
    rows = texts.where(F.col("path").rlike(r"(^|/)package[^/]*\.json$")).select("path", F.from_json("text", schema).alias("x")).where("x is not null")
    out = rows.select("path", F.lit("entrypoint").alias("kind"), F.explode(F.create_map(F.lit("main"), F.col("x.main"), F.lit("module"), F.col("x.module"))).alias("name", "value"))
    out = out.unionByName(rows.select("path", F.lit("script").alias("kind"), F.explode("x.scripts").alias("name", "value")))
    for d in deps:
        out = out.unionByName(rows.select("path", F.lit("dep").alias("kind"), F.explode(f"x.{d}").alias("name", "value")))
    return out.where("value is not null")


def relaxed_json(text: str) -> dict:
    """JSON with comments and trailing commas, as build tools write it."""
    bare = re.sub(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*.*?\*/", lambda m: m.group(1) or "", text, flags=re.S)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))


def alias_rules(config: str, base: str = "") -> list[tuple[str, str]]:
    """(prefix, target prefix) pairs of a tsconfig's paths, in order; exact aliases have no star."""
    options = relaxed_json(config).get("compilerOptions", {})
    root = "/".join(p for p in (base, options.get("baseUrl", "").strip("./")) if p)
    return [(alias, "/".join(x for x in (root, target.removeprefix("./")) if x)) for alias, targets in options.get("paths", {}).items() for target in targets]


def resolve_aliases(specs: DataFrame, rules: list[tuple[str, str]], files: DataFrame, endings: tuple[str, ...] = ("", ".ts", ".tsx", ".js", "/index.ts", "/index.js")) -> DataFrame:
    """(spec, dst): the first indexed file that an alias rule and an ending lead to; null if none does."""
    asked = specs.where("spec is not null").select("spec").distinct()
    options = []
    for alias, target in rules:
        head, star, tail = alias.partition("*")
        hit = F.col("spec").startswith(head) & F.col("spec").endswith(tail) if star else F.col("spec") == alias
        middle = F.expr(f"substring(spec, {len(head) + 1}, length(spec) - {len(head) + len(tail)})")
        stem = F.concat(F.lit(target.partition("*")[0]), middle, F.lit(target.partition("*")[2])) if "*" in target else F.lit(target)
        options += [F.when(hit, F.concat(stem, F.lit(e))) for e in endings]
    if not options:
        return asked.withColumn("dst", F.lit(None).cast("string"))
    candidates = asked.select("spec", F.posexplode(F.array(*options)).alias("rank", "dst")).where("dst is not null")
    known = candidates.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy("spec").agg(F.min(F.struct("rank", "dst"))["dst"].alias("dst"))
    return asked.join(known, "spec", "left")


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, dst): the file of a Python import: relative to the package for leading dots, else from the root, else beside the importer or above it, nearest first."""
    asked = imports.where("module <> ''").select("path", "module").distinct()
    dirs = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    under = lambda folder: F.concat(F.array_join(folder, "/"), F.when(F.size(folder) > 0, "/").otherwise(""), rest)
    relative = F.array(under(F.slice(dirs, 1, F.greatest(F.size(dirs) - dots + 1, F.lit(0)))))
    upward = F.concat(F.array(rest), F.transform(F.sequence(F.size(dirs), F.lit(0), F.lit(-1)), lambda n: under(F.slice(dirs, 1, n))))
    stems = F.when(dots > 0, relative).otherwise(upward)
    paths = F.flatten(F.transform(stems, lambda s: F.array(F.concat(F.regexp_replace(s, "/$", ""), F.lit(".py")), F.concat(F.regexp_replace(s, "/$", ""), F.lit("/__init__.py")))))
    candidates = asked.select("path", "module", F.posexplode(paths).alias("rank", "dst"))
    known = candidates.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy("path", "module").agg(F.min(F.struct("rank", "dst"))["dst"].alias("dst"))
    return asked.join(known, ["path", "module"], "left")


def integrity_scores(annotations: DataFrame, symbols: DataFrame, refs: DataFrame, edges: DataFrame, files: DataFrame, texts: DataFrame, now: float) -> DataFrame:
    """(target, score, factors...) per distinct target of notes: the weighted sum of nine factors between 0 and 1."""
    living = annotations.where(alive(now) & F.col("target").isNotNull())
    decay = F.create_map(*(F.lit(x) for pair in DECAY.items() for x in pair))
    unfounded = F.col("staleness").isin("weakly_stale", "strongly_stale") & F.col("fingerprint").isNull()
    base = living.groupBy("target").agg(F.avg(F.coalesce(decay[F.coalesce("staleness", F.lit("unknown"))], F.lit(0.5))).alias("note_freshness"), F.when(F.bool_or(unfounded), 0.7).otherwise(1.0).alias("stale_recovery_penalty"))
    base = base.withColumn("x", parse_target(F.col("target"))).select("*", "x.file", "x.name").drop("x")
    severities = (
        kind_conflicts(annotations, now).select("target", "severity")
        .unionByName(deleted_targets(annotations, files, now).select("target").distinct().withColumn("severity", F.lit("high")))
        .unionByName(tier_contradictions(annotations, texts, now).select("id").join(living.select("id", "target"), "id").select("target", F.lit("high").alias("severity")))
    )
    cost = F.when(F.col("severity") == "high", 0.6).when(F.col("severity") == "medium", 0.3).otherwise(0.1)
    conflicts = severities.groupBy("target").agg(F.sum(cost).alias("conflict"))
    unclear = ambiguous_targets(annotations, symbols).select("target", F.when(F.col("severity") == "high", 0.5).otherwise(0.25).alias("unclear"))
    known_files = files.select(F.col("path").alias("file"), F.lit(True).alias("known"))
    in_file = refs.where("file is not null").groupBy("file").agg(F.count("*").alias("refs_in_file"))
    inward = edges.where((F.col("type") == "imports") & F.col("dst").rlike(r"^(module|binding):[./]")).groupBy(F.col("src").alias("file")).agg(F.count("*").alias("unresolved"))
    named = base.where("name is not null").select("name").distinct()
    defs = symbols.join(named, "name", "left_semi").groupBy("name").agg(F.count("*").alias("defs"))
    uses = refs.join(named, "name", "left_semi").groupBy("name").agg(F.count("*").alias("uses"))
    hits = occurrences(texts, named).select("name", "hits")
    native = edges.where((F.col("type") == "imports") & (F.col("dst").startswith("binding:") | F.col("dst").endswith(".cc") | F.col("evidence").contains("internalBinding("))).select(F.col("src").alias("file")).distinct()
    bound = refs.where("kind in ('call', 'new')").join(named, "name", "left_semi").select("name", "file").distinct().join(native, "file", "left_semi").select("name").distinct().withColumn("native", F.lit(True))
    j = base.join(conflicts, "target", "left").join(unclear, "target", "left").join(known_files, "file", "left").join(in_file, "file", "left").join(inward, "file", "left")
    j = j.join(defs, "name", "left").join(uses, "name", "left").join(hits, "name", "left").join(bound, "name", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    structured = n("defs") + n("uses")
    ratio = F.when(structured > 0, n("hits") / structured).otherwise(F.when(n("hits") > 0, float("inf")).otherwise(0.0))
    implicit = (n("hits") - structured >= 5) & (ratio >= 1.25)
    factors = {
        "retrieval_confidence": F.when(F.col("known"), F.when(F.col("conflict").isNull(), 0.9).otherwise(0.7)).when(n("defs") > 0, 0.8).otherwise(0.5),
        "note_freshness": F.col("note_freshness"),
        "contradiction_penalty": F.greatest(F.lit(0.0), 1.0 - F.coalesce("conflict", F.lit(0.0))),
        "ambiguity_penalty": F.greatest(F.lit(0.0), 1.0 - F.coalesce("unclear", F.lit(0.0))),
        "structural_coverage": F.when(n("refs_in_file") >= 5, 0.9).when(n("refs_in_file") > 0, 0.7).otherwise(0.5),
        "macro_gap_penalty": F.when(implicit, F.when(ratio >= 8, 0.1).when(ratio >= 4, 0.3).when(ratio >= 2, 0.6).when(ratio >= 1.5, 0.75).otherwise(0.85)).otherwise(1.0),
        "binding_gap_penalty": F.when(F.col("native") & F.col("name").isNotNull() & (n("defs") == 0), 0.3).otherwise(1.0),
        "module_resolution_penalty": F.greatest(F.lit(0.3), 1.0 - n("unresolved") * 0.1),
        "stale_recovery_penalty": F.col("stale_recovery_penalty"),
    }
    scored = j.select("target", *(c.alias(k) for k, c in factors.items()))
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + F.col(k) * w
    return scored.withColumn("score", F.round(total, 4))


def findings(parts: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """(family, severity, findings): counts of families of findings, those with any."""
    out = None
    for family, (severity, rows) in parts.items():
        one = rows.agg(F.count("*").alias("findings")).select(F.lit(family).alias("family"), F.lit(severity).alias("severity"), "findings")
        out = one if out is None else out.unionByName(one)
    return out.where("findings > 0")


def overview(files: DataFrame) -> DataFrame:
    """(lang, kind, files, bytes): the mix of languages, by source, artifact and generated files."""
    return files.groupBy(F.coalesce("lang", F.lit("other")).alias("lang"), artifact_class(F.col("path"))["kind"].alias("kind")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def dot(nodes: DataFrame, edges: DataFrame, most: int = 150) -> str:
    """A graph of few nodes (node, hop) and their edges (src, dst) as DOT text; the limit is that of a picture."""
    names = [r["node"] for r in nodes.orderBy("hop", "node").limit(most).collect()]
    kept = edges.sparkSession.createDataFrame([(n,) for n in names], "node string")
    inner = edges.join(F.broadcast(kept.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(kept.withColumnRenamed("node", "dst")), "dst", "left_semi").select("src", "dst").distinct().orderBy("src", "dst")
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"  {quoted(n)};" for n in names] + [f"  {quoted(r['src'])} -> {quoted(r['dst'])};" for r in inner.collect()]
    return "digraph {\n" + "\n".join(lines) + "\n}\n"


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 150) -> str:
    """As dot, as a Mermaid flowchart with numbered nodes."""
    names = [r["node"] for r in nodes.orderBy("hop", "node").limit(most).collect()]
    number = {n: i for i, n in enumerate(names)}
    kept = edges.sparkSession.createDataFrame([(n,) for n in names], "node string")
    inner = edges.join(F.broadcast(kept.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(kept.withColumnRenamed("node", "dst")), "dst", "left_semi").select("src", "dst").distinct().orderBy("src", "dst")
    lines = [f"  n{i}[\"{n.replace(chr(34), '&quot;')}\"]" for n, i in number.items()] + [f"  n{number[r['src']]} --> n{number[r['dst']]}" for r in inner.collect()]
    return "flowchart LR\n" + "\n".join(lines) + "\n"
