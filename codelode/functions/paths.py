"""Column expressions over paths, targets and symbol ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Results must equal those of tools that classify paths this way.
ARTIFACT_DIRS = (
    "dist", "build", "out", "generated", "__generated__", "auto_generated", "coverage", "node_modules", "vendor", "third_party", "third-party",
    "tests/baselines", "testRunner/fixtures", "changelogs", "doc/changelogs", "__snapshots__",
)
ARTIFACT_NAMES = (
    (r"\.snap$", "artifact", "jest snapshot"), (r"\.baseline$", "artifact", "baseline output"), (r"\.bak$", "artifact", "backup file"),
    (r"\.min\.(js|css)$", "generated", "minified bundle"), (r"\.bundle\.(js|css)$", "generated", "bundled output"), (r"\.map$", "generated", "sourcemap"),
    (r"\.lock$", "artifact", "lock file"), (r"\.lockb$", "artifact", "lock file"), (r"_pb2\.py$", "generated", "protobuf-generated"),
    (r"_pb2_grpc\.py$", "generated", "grpc-generated"), (r"\.pb\.go$", "generated", "protobuf-generated"), (r"\.d\.ts$", "generated", "type declaration"),
)
VENDOR_PREFIXES = (
    "chrome/", "node_modules/", "vendor/", "third_party/", "_archive/", "bower_components/", "external/", "deps/", "Pods/",
    "build/", "dist/", "out/", "target/", ".tox/", ".venv/", "venv/", "env/",
)
DOC_EXTENSIONS = (".md", ".markdown", ".txt", ".rst", ".adoc", ".asciidoc", ".org", ".rtf")
SOURCE_ROOTS = ("src", "app", "lib", "packages", "internal", "pkg")
SUFFIX_OF_KIND = {
    "function": ".", "method": ".", "exported": ".", "var": ".", "const": ".", "getter": ".", "setter": ".",
    "class": "#", "interface": "#", "struct": "#", "enum": "#", "trait": "#", "type": "#", "type_alias": "#", "union": "#", "protocol": "#",
    "module": "/", "object": "/", "package": "/", "namespace": "/", "macro": "!",
}
SYMBOL_SUFFIXES = (".", "#", "/", "!")
VIRTUAL = r"^(module|builtin|binding):"
# End of fixed values.


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def artifact_class(path: Column) -> Column:
    """struct(kind, reason): `source` with a null reason, `artifact` or `generated`; directories decide before names."""
    in_dir = F.regexp_extract(path, r"(?:^|/)(" + "|".join(map(re.escape, ARTIFACT_DIRS)) + r")(?:/|$)", 1)
    name = base_name(path)
    kind = F.when(in_dir != "", "artifact").when(path.rlike(r"(?i)(^|/)CHANGELOG[_.-]?[A-Z0-9]*\.md$"), "artifact")
    reason = F.when(in_dir != "", F.concat(in_dir, F.lit("/ directory"))).when(path.rlike(r"(?i)(^|/)CHANGELOG[_.-]?[A-Z0-9]*\.md$"), "changelog markdown")
    for pattern, what, why in ARTIFACT_NAMES:
        hit = name.rlike("(?i)" + pattern)
        kind, reason = kind.when(hit, what), reason.when(hit, why)
    return F.struct(kind.otherwise("source").alias("kind"), reason.alias("reason"))


def is_artifact(path: Column) -> Column:
    """Whether artifact_class gives anything but source, by two patterns."""
    in_dir = path.rlike(r"(?:^|/)(?:" + "|".join(map(re.escape, ARTIFACT_DIRS)) + r")(?:/|$)")
    by_name = path.rlike(r"(?i)(?:(?:^|/)CHANGELOG[_.-]?[A-Z0-9]*\.md$|" + "|".join(p for p, _, _ in ARTIFACT_NAMES) + ")")
    return F.coalesce(in_dir | by_name, F.lit(False))


def in_scope(path: Column, prefixes: tuple[str, ...] = VENDOR_PREFIXES) -> Column:
    """Not under a prefix of other projects or outputs; null, empty and `<config>` paths are in scope."""
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p) | (path == p.rstrip("/"))
    return path.isNull() | path.isin("", "<config>") | ~out


def is_test(path: Column) -> Column:
    p, name = F.lower(path), F.lower(base_name(path))
    by_name = name.startswith("test_") | name.endswith("_test.py") | name.endswith("_test.go") | name.contains(".test.") | name.contains(".spec.")
    return F.coalesce(F.concat(F.lit("/"), p).rlike(r"/tests?/") | by_name, F.lit(False))


def is_doc_only(path: Column) -> Column:
    return F.coalesce(F.lower(path).rlike("(" + "|".join(map(re.escape, DOC_EXTENSIONS)) + ")$"), F.lit(False))


def ancestors(path: Column) -> Column:
    """The directories of a path, each with a final slash, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def suffixes(path: Column) -> Column:
    """All endings of a path that begin at a segment, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def symbol_id(file: Column, name: Column, kind: Column) -> Column:
    """`file#name` and the suffix of the kind, `.` for unknown kinds; `?` stands for what is missing."""
    suffix = F.create_map(*(F.lit(x) for pair in SUFFIX_OF_KIND.items() for x in pair))
    whole = F.concat(file, F.lit("#"), name, F.coalesce(suffix[kind], F.lit(".")))
    missing = file.isNull() | (file == "") | name.isNull() | (name == "")
    return F.when(missing, F.concat(F.coalesce(F.nullif(file, F.lit("")), F.lit("?")), F.lit("#"), F.coalesce(F.nullif(name, F.lit("")), F.lit("?")), F.lit("?"))).otherwise(whole)


def parse_symbol_id(sid: Column) -> Column:
    """struct(file, name, suffix, kind_hint) of a symbol id; null without a `#`."""
    rest = F.regexp_extract(sid, r"(?s)#(.*)$", 1)
    suffix = F.nullif(F.regexp_extract(rest, r"([.#/!])$", 1), F.lit(""))
    hint = F.when(suffix == "#", "type").when(suffix == ".", "term").when(suffix == "/", "namespace").when(suffix == "!", "macro")
    name = F.when(suffix.isNull(), rest).otherwise(F.regexp_replace(rest, r"[.#/!]$", ""))
    return F.when(sid.contains("#"), F.struct(F.regexp_extract(sid, r"^([^#]*)", 1).alias("file"), name.alias("name"), suffix.alias("suffix"), hint.alias("kind_hint")))


def parse_target(target: Column) -> Column:
    """struct(file, name): of `file#name` with or without suffix, or of a path whose last part has a dot; nulls for others."""
    file = F.when(target.contains("#"), F.nullif(F.regexp_extract(target, r"^([^#]*)", 1), F.lit(""))).when(base_name(target).contains(".") & ~target.startswith("$"), target)
    name = F.when(target.contains("#"), F.nullif(F.regexp_extract(target, r"#([^.#/!]*)", 1), F.lit("")))
    return F.struct(file.alias("file"), name.alias("name"))


def is_virtual(node: Column) -> Column:
    return F.coalesce(node.rlike(VIRTUAL), F.lit(False))


def module_of(path: Column, root: str | None) -> Column:
    """The child of the source root that most files lie under, if there is one; else the first segment."""
    first = F.regexp_extract(path, r"^([^/]*)", 1)
    if not root:
        return first
    return F.when(path.startswith(root + "/"), F.regexp_extract(path, r"^([^/]*/[^/]*)", 1)).otherwise(first)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression: `*` and `?` match slashes too, [..] are classes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")))
            if j < 0:
                out.append(r"\[")
            else:
                inner = pattern[i:j].replace("\\", r"\\")
                out.append("[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]")
                i = j + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches the path, or its last part if the pattern has no slash; `**/` and `/**` may stand for nothing."""
    out, name = F.lit(False), base_name(path)
    for p in patterns:
        short = p.replace("**/", "").replace("/**", "")
        out = out | path.rlike(glob_regex(p)) | path.rlike(glob_regex(short))
        if "/" not in short:
            out = out | name.rlike(glob_regex(short))
    return F.coalesce(out, F.lit(False))


def matches_segments(path: Column, pattern: str) -> Column:
    """Whether a pattern in which `**` stands for any number of segments, also none, matches the path or its end."""
    pattern = pattern.strip()
    if not pattern:
        return F.lit(False)
    if pattern in ("**", "*", "**/*", "**/**"):
        return path.isNotNull()
    out = F.lit(False)
    for p in sorted({pattern, pattern.replace("**/", ""), pattern.replace("/**/", "/"), pattern.replace("**", "*")}):
        segment = glob_regex(p).replace("(?s)^", "").replace(".*", "[^/]*")
        start = "^" if p.startswith("/") else "(^|/)"
        out = out | path.rlike(start + segment) | path.rlike(glob_regex(p))
    return F.coalesce(out, F.lit(False))
