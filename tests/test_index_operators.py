"""Operators that SQL can't express, or whose cases the tables don't have, on small literals."""

import json

from pyspark.sql import functions as F

from codelode.functions import paths as P
from codelode.operators import binding, claims, diffs, extract, graph, integrity, lookups, packs, reports, rewrites
from codelode.sources import listing, notes, patches


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_python_syntax_tree(spark):
    src = "import os\nfrom .core import run as r\nSTATUS = 1\nclass A(B):\n    def f(self):\n        if FLAG:\n            go()\n        return os.getenv('X')\n"
    out = extract.index_python(texts(spark, ("a.py", src), ("bad.py", "def (\n"), ("none.py", None), ("empty.py", "")))
    assert rows(out.where("what = 'symbol'"), "name", "kind", "line", "end_line") == [("A", "class", 4, 8), ("STATUS", "var", 3, 3), ("f", "function", 5, 8)]
    assert rows(out.where("what = 'import'"), "name") == [(".core",), ("os",)]
    assert rows(out.where("what = 'extends'"), "name", "kind") == [("B", "A")]
    assert rows(out.where("what = 'guarded'"), "name", "kind") == [("go", "FLAG")]
    assert rows(out.where("what = 'ref'"), "name") == [("getenv",), ("go",)]
    assert rows(out.where("what = 'error'"), "path") == [("bad.py",)]


def test_contracts_outside_comments_and_strings(spark):
    js = "const a = process.env.TOKEN; // process.env.NOT\nconst s = 'process.env.NEITHER';\nrun(x, --dry-run)\n"
    py = "import os\na = os.environ['DB_URL']\nb = os.getenv(\"MODE\")  # os.getenv('NO')\n"
    out = extract.contracts(texts(spark, ("a.js", js), ("b.py", py), ("c.js", None)))
    assert rows(out, "path", "kind", "name") == [("a.js", "env", "TOKEN"), ("a.js", "flag", "dry-run"), ("b.py", "env", "DB_URL"), ("b.py", "env", "MODE")]
    assert extract.mask("a = 'x\\'y' # c\n\"\"\"d\n\"\"\"", True, True) == "a = " + " " * 10 + "\n    \n   "
    assert len(extract.mask("/* open", False, False)) == 7


def test_enums_tokens_and_entrypoints(spark):
    t = texts(spark, ("a.ts", "export enum Kind { B = 'B_X', A, A }\nenum E {}\n"), ("m.py", "if __name__ == '__main__':\n    f('READY_NOW')\n"), ("src/main.go", "package main\n"))
    assert rows(extract.enum_shapes(t), "name", "members") == [("E", []), ("Kind", ["A", "B"])]
    assert rows(extract.tokens(t), "name") == [("B_X",), ("READY_NOW",)]
    assert rows(extract.entrypoints(t), "path", "kind") == [("m.py", "guard"), ("src/main.go", "name")]


def test_relative_imports(spark):
    files = spark.createDataFrame([("a/b/x.ts",), ("a/y/index.js",), ("a/b/z.ts",), ("w.js",)], "path string")
    specs = spark.createDataFrame([("a/b/c.ts", "./x"), ("a/b/c.ts", "../y"), ("a/b/c.ts", "./z.js"), ("a/b/c.ts", "../../w"), ("a/b/c.ts", "./no"), ("a/b/c.ts", "react")], "path string, spec string")
    assert {(r["spec"], r["dst"]) for r in extract.resolve_relative(specs, files).collect()} == {("./x", "a/b/x.ts"), ("../y", "a/y/index.js"), ("./z.js", "a/b/z.ts"), ("../../w", "w.js"), ("./no", None)}
    py = spark.createDataFrame([("pkg/core.py",), ("pkg/__init__.py",), ("pkg/sub/util.py",), ("top.py",)], "path string")
    mods = spark.createDataFrame([("pkg/sub/m.py", "..core"), ("pkg/sub/m.py", ".util"), ("pkg/sub/m.py", "util"), ("pkg/sub/m.py", "top"), ("pkg/sub/m.py", "pkg"), ("pkg/sub/m.py", "os")], "path string, module string")
    assert {(r["module"], r["dst"]) for r in reports.resolve_python(mods, py).collect()} == {("..core", "pkg/core.py"), (".util", "pkg/sub/util.py"), ("util", "pkg/sub/util.py"), ("top", "top.py"), ("pkg", "pkg/__init__.py"), ("os", None)}


def test_aliases(spark):
    config = '{ // paths\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["./src/*"], "cfg": ["src/config.ts"], }, }, }'
    rules = reports.alias_rules(config)
    assert rules == [("@/*", "src/*"), ("cfg", "src/config.ts")]
    files = spark.createDataFrame([("src/a/b.ts",), ("src/config.ts",), ("src/u/index.ts",)], "path string")
    specs = spark.createDataFrame([("@/a/b",), ("cfg",), ("@/u",), ("@/no",), ("react",)], "spec string")
    assert {(r["spec"], r["dst"]) for r in reports.resolve_aliases(specs, rules, files).collect()} == {("@/a/b", "src/a/b.ts"), ("cfg", "src/config.ts"), ("@/u", "src/u/index.ts"), ("@/no", None), ("react", None)}
    assert reports.resolve_aliases(specs, [], files).where("dst is not null").count() == 0


def test_package_entries(spark):
    good = json.dumps({"main": "i.js", "scripts": {"t": "x"}, "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}})
    out = reports.package_entries(texts(spark, ("package.json", good), ("x/package.json", "[1"), ("other.json", good)))
    assert rows(out, "kind", "name", "value") == [("dep", "a", "^1"), ("dep", "b", "2"), ("entrypoint", "main", "i.js"), ("script", "t", "x")]


def test_claims_of_texts(spark):
    body = "@defined-at(`f`, a.py:3) @Env-Read-At(X, 'c.ts:4') @bad(one)\n`gg` is defined at src/b.py:7. `hh` is exported from src/b.py and src/b.py:9 @defined-at(f, a.py:3)\n@open(x, y"
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, text string")
    assert rows(claims.extracted_claims(docs, "id", "text"), "predicate", "subject", "object") == [("defined-at", "f", "a.py:3"), ("defined-at", "gg", "src/b.py:7"), ("env-read-at", "X", "c.ts:4"), ("exported-from", "hh", "src/b.py")]
    assert rows(claims.malformed_claims(docs, "id", "text"), "predicate", "reason") == [("bad", "no_comma"), ("open", "unclosed")]
    assert ("src/b.py", 9) in rows(claims.cited_lines(docs, "id", "text"), "path", "line")


def test_verdicts_of_places(spark):
    files = spark.createDataFrame([("src/a.py",), ("x/b.py",), ("y/b.py",)], "path string")
    symbols = spark.createDataFrame([("src/a.py", "f", 3), ("src/a.py", "f", 9), ("x/b.py", "g", 1)], "file string, name string, line int")
    asked = [("1", "f", "src/a.py:3"), ("2", "f", "a.py:9"), ("3", "f", "src/a.py:4"), ("4", "g", "src/a.py:1"), ("5", "g", "b.py:1"), ("6", "f", "src/a.py"), ("7", "zz", "src/a.py:1"), ("8", "f", "gone.py:1")]
    out = claims.verify_defined_at(spark.createDataFrame(asked, "claim string, subject string, object string"), symbols, files)
    assert dict(rows(out, "claim", "verdict")) == {"1": "VERIFIED", "2": "VERIFIED", "3": "MOVED", "4": "REFUTED", "5": "UNCHECKABLE", "6": "UNCHECKABLE", "7": "REFUTED", "8": "REFUTED"}


def test_note_status(spark):
    v = [(1, "VERIFIED", "FACT", 1.0), (1, "UNCHECKABLE", "FACT", 1.0), (2, "REFUTED", "FACT", 0.5), (3, "REFUTED", "INFERENCE", 0.5), (4, "MOVED", "FACT", 0.5), (5, "VERIFIED", "FACT", 0.5), (6, "UNCHECKABLE", "FACT", 0.0)]
    out = claims.note_status(spark.createDataFrame(v, "id int, verdict string, truth_class string, confidence double"))
    assert {r["id"]: (r["status"], r["confidence"]) for r in out.collect()} == {1: ("weakly_stale", 0.75), 2: ("contradicted", 0.0), 3: ("strongly_stale", 0.0), 4: ("weakly_stale", 0.0), 5: ("fresh", 1.0), 6: ("unknown", None)}


def test_binding_tiers(spark):
    symbols = spark.createDataFrame([("a", "f", 1, "a#f."), ("b", "f", 1, "b#f."), ("c", "g", 1, "c#g."), ("d", "h", 1, "d#h."), ("e", "h", 1, "e#h."), ("z", "only", 1, "z#only.")], "file string, name string, line int, symbol_id string")
    edges = spark.createDataFrame([("x", "b", "imports"), ("x", "bar", "imports"), ("bar", "mid", "reexport_star"), ("mid", "d", "reexport_star"), ("d", "bar", "reexport_star")], "src string, dst string, type string")
    refs = spark.createDataFrame([(1, "a", "f", None), (2, "x", "f", None), (3, "x", "h", None), (4, "q", "only", None), (5, "q", "f", None), (6, "q", "no", None), (7, "q", None, None), (8, "q", "f", "kept"), (9, None, "only", None)], "id int, file string, name string, target_symbol_id string")
    out = {r["id"]: (r["tier"], r["target_symbol_id"]) for r in binding.resolve_refs(refs, symbols, edges).collect()}
    assert out == {1: ("same_file", "a#f."), 2: ("imported", "b#f."), 3: ("reexport", "d#h."), 4: ("global_unique", "z#only."), 5: ("ambiguous", None), 6: ("no_match", None), 7: ("no_match", None), 8: ("already_bound", "kept"), 9: ("global_unique", "z#only.")}


def test_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", None)], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reach(edges, seed, 9), "node", "hop") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.trace(edges, "a", "d", 5), "step", "node") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert graph.trace(edges, "d", "a", 5).count() == 0
    nodes = graph.reach(edges, seed, 1).select("node", "hop")
    assert reports.dot(nodes, edges) == 'digraph {\n  "a";\n  "b";\n  "a" -> "b";\n}\n'
    assert reports.mermaid(nodes, edges) == 'flowchart LR\n  n0["a"]\n  n1["b"]\n  n0 --> n1\n'
    assert graph.java_module("src/main/java/a/B.java") == "a.B" and graph.java_module("a.py") is None


def test_moves_and_contract_diffs(spark):
    schema = "kind string, name string, file string"
    base = spark.createDataFrame([("env", "A", "x"), ("env", "B", "x"), ("env", "C", "x"), ("env", "C", "y"), ("env", "D", "x")], schema)
    head = spark.createDataFrame([("env", "A", "y"), ("env", "B", "x"), ("env", "C", "z"), ("env", "E", "x"), ("env", "B", "x")], schema)
    out = {r["name"]: r["status"] for r in diffs.site_diff(base, head, ["kind", "name"], "file").collect()}
    assert out == {"A": "moved", "B": "unchanged", "C": "moved", "D": "removed", "E": "added"}
    assert {(r["name"], r["shape"]) for r in diffs.moved_keys(base, head, ["kind", "name"], "file").collect()} == {("A", "1to1"), ("C", "merge")}
    flags = spark.createDataFrame([("dry-run-now",), ("x",)], "name string")
    assert {tuple(sorted(r[0])) for r in flags.select(diffs.name_variants(F.col("name"))).collect()} == {("dry-run-now", "dryRunNow", "dry_run_now"), ("x",)}


def test_patches(spark):
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,4 @@ def f\n a\n@@ -10 +12,0 @@\n-b\n--- a/gone.py\n+++ /dev/null\n@@ -1,5 +0,0 @@\n-c\n"
    assert patches.hunks_of(patch) == [("x.py", 0, 3, 2, 3, 4), ("x.py", 1, 10, 1, 12, 0), ("gone.py", 0, 1, 5, 0, 0)]
    hunks = patches.parse_patches(spark.createDataFrame([(1, patch), (2, None), (3, "")], "id int, p string"), "id", "p")
    lines = spark.createDataFrame([("x.py", 2), ("x.py", 4), ("x.py", 7), ("x.py", 20), ("gone.py", 2), ("other.py", 1)], "file string, line int")
    assert {(r["file"], r["line"]): (r["status"], r["new_line"]) for r in patches.classify_lines(lines, hunks).collect()} == {
        ("x.py", 2): ("unaffected", None), ("x.py", 4): ("at_risk", None), ("x.py", 7): ("moved", 9), ("x.py", 20): ("moved", 21), ("gone.py", 2): ("at_risk", None), ("other.py", 1): ("unaffected", None),
    }


def test_listing_of_a_tree(spark, tmp_path):
    for name, content in (("src/a.py", b"x = 1\n"), ("src/b.bin", b"\xff\x00"), ("node_modules/c.js", b""), ("tool", b"#!/usr/bin/env python3\n"), ("h.h", b"class A {\n"), (".git/config", b"")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    tree = listing.list_tree(spark, str(tmp_path))
    kept = tree.where(listing.kept(F.col("path"), [], ["*.bin"])).withColumn("text", listing.decoded(F.col("content")))
    said = kept.select("path", listing.language(F.col("path"), F.regexp_extract("text", r"^([^\n]*)", 1)).alias("lang"))
    assert rows(said, "path", "lang") == [("h.h", "c"), ("src/a.py", "python"), ("tool", "python")]
    assert rows(listing.oversize(tree, 10), "path") == [("h.h",), ("tool",)] or rows(listing.oversize(tree, 10), "path") == [("tool",)]
    assert tree.select(listing.decoded(F.col("content")).alias("t")).where("t like '�%'").count() == 1


def test_ignore_rules_the_last_match_holds(spark):
    rules = listing.parse_ignore("# c\n\nbuild/\n!build/keep.py\n/top\n*.log\n\\#x\n")
    assert rules == [("build", False, True, False), ("build/keep.py", True, False, False), ("top", False, False, True), ("*.log", False, False, False), ("#x", False, False, False)]
    df = spark.createDataFrame([("build/a",), ("x/build/a",), ("build/keep.py",), ("top",), ("x/top",), ("a/b.log",), ("c",)], "path string")
    assert rows(df.where(listing.ignored(F.col("path"), rules)), "path") == [("a/b.log",), ("build/a",), ("top",), ("x/build/a",)]


def test_notes_and_evidence(spark):
    files, symbols = spark.createDataFrame([("a.py",)], "path string"), spark.createDataFrame([("f", "a.py#f.")], "name string, symbol_id string")
    lines = spark.createDataFrame([('{"file": "a.py", "kind": "hit"}',), ('{"symbol": "f"}',), ('{"target": "no"}',), ('{"kind": "hit"}',), ("{bad",), (" ",)], "value string")
    assert rows(notes.read_evidence(lines, files, symbols).groupBy("state").count(), "state", "count") == [("bad", 1), ("invalid_target", 1), ("missing_target", 1), ("ok", 2)]
    schema = "target string, kind string, body string"
    new = notes.new_notes(spark.createDataFrame([("a", "k", "b"), ("a", "k", "b"), ("a", "k", "old"), (None, "k", "b")], schema), spark.createDataFrame([("a", "k", "old")], schema))
    assert sorted((r["target"] or "", r["body"]) for r in new.collect()) == [("", "b"), ("a", "b")]
    assert json.loads(notes.exported(spark.createDataFrame([("a", "k", None)], schema)).first()[0]).keys() == {"target", "kind", "sha1"}


def test_rewrites(spark):
    notes_ = spark.createDataFrame([(1, "a.py#f", None, 1.0), (2, "b.py", None, 1.0), (3, "src/x.py", 50.0, 99.0), (4, "@project", None, 99.0)], "id int, target string, expires_at double, created_at double")
    moved = rewrites.retarget(notes_, spark.createDataFrame([("a.py", "z/a.py")], "old string, new string"))
    assert rows(moved, "id", "target")[0] == (1, "z/a.py#f")
    out = rewrites.expire(notes_, spark.createDataFrame([("b.py",)], "path string"), now=100.0, age=50.0)
    assert {r["id"]: r["expires_at"] for r in out.collect()} == {1: 100.0, 2: 100.0, 3: 50.0, 4: None}
    log = spark.createDataFrame([("k", 1.0, "a"), ("k", 2.0, "b"), ("k", 2.0, "a")], "key string, ts double, v string")
    assert rewrites.latest_version(log, ("key",), "ts").first()["v"] == "b"


def test_staleness(spark):
    notes_ = spark.createDataFrame([(1, "a", "fresh", "h1", 0.8), (2, "a", "weakly_stale", "h", 0.8), (3, "a", "fresh", None, 0.8)], "id int, target string, staleness string, h string, confidence double")
    notes_ = notes_.select("id", "target", "staleness", "confidence", F.lit(None).cast("double").alias("confidence_base"), F.lit("note").alias("kind"), F.when(F.col("h").isNotNull(), F.struct(F.col("h").alias("file_hash"), F.lit(None).cast("string").alias("callers_hash"))).alias("fingerprint"))
    now = spark.createDataFrame([("a", "h", None)], "target string, file_hash string, callers_hash string")
    assert {r["id"]: (r["staleness"], r["confidence"]) for r in integrity.revalidate(notes_, now).collect()} == {1: ("weakly_stale", 0.4), 2: ("recovered", 0.8), 3: ("unknown", 0.6000000000000001)}


def test_paths(spark):
    df = spark.createDataFrame([("src/./a/../b.py",), ("./x",), ("../y",), ("/r//s",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(reports.normal_path(F.col("p"))).collect()] == ["src/b.py", "x", "../y", "/r/s", "", None]
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(P.symbol_id(F.lit("a"), F.lit("f"), F.lit("class"))) == "a#f#" and value(P.symbol_id(F.lit(None), F.lit("f"), F.lit("x"))) == "?#f?"
    assert value(P.matches_any(F.lit("a/b/c.py"), ["a/**/c.py"])) and not value(P.matches_any(F.lit("a/b/c.py"), ["b/*"]))
    assert value(P.matches_segments(F.lit("p/store.py"), "p/**/*.py")) and value(P.matches_segments(F.lit("p/x/store.py"), "p/**/*.py"))
    assert value(lookups.describe_roles(F.lit(136))) == ["read", "call"]
    assert value(reports.question_shape(F.lit("Who calls `f`?"))) == "who_uses" and value(reports.question_subject(F.lit("Who calls `f`?"))) == "f"


def test_packs(spark):
    paths = spark.createDataFrame([("p/a.py",), ("p/q/b.py",), ("c.js",)], "path string")
    lifelines = spark.createDataFrame([("l1", "c.js"), ("l2", "gone.js")], "id string, current_path string")
    skills = spark.createDataFrame([("s1", "py", "p/**/*.py", 1), ("s2", "off", "**", 0), ("s3", "pin", None, 1)], "id string, name string, scope_pattern string, enabled int")
    pins = spark.createDataFrame([("s3", "l1"), ("s3", "l2"), ("s2", "l1")], "skill_id string, lifeline_id string")
    assert rows(packs.matching_skills(paths, lifelines, skills, pins), "path", "name", "via") == [("c.js", "pin", "attached"), ("p/a.py", "py", "pattern"), ("p/q/b.py", "py", "pattern")]
    assert packs.matching_skills(paths, lifelines, skills.limit(0), pins).count() == 0
    cc = 'SetMethod(context, target, "open", Open);\nSetMethodNoSideEffect(isolate, t, "stat", fs::Stat);\n'
    assert rows(packs.native_bindings(texts(spark, ("a.cc", cc), ("b.cc", None))), "js_name", "cpp_name") == [("open", "Open"), ("stat", "Stat")]
    found = spark.createDataFrame([("notes", "2"), ("notes", "1"), ("symbols", "f")], "section string, item string")
    assert packs.pack_markdown("a.py", found, most=1) == "# a.py\n\n## notes\n- 1\n- and 1 more\n\n## symbols\n- f\n"
    src = "a\nb\nc\n"
    assert rows(packs.excerpts(spark.createDataFrame([("x", 2), ("x", 9), ("x", None)], "file string, line int"), texts(spark, ("x", src)), 2, 10), "line", "text") == [(2, "b\nc")]
