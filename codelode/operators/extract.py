"""Symbols, references, imports, contracts and words from source texts.

Patterns run as built-in expressions over whole texts. Only Python's own syntax tree and the masking
of comments and strings need Python; both go through one Arrow batch pass without a shuffle.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

# Patterns that results must equal.
JS_IMPORT = r"(?m)^\s*(?:import\s+(?:[\w*{}\s,$]+\s+from\s+)?|export\s+[\w*{}\s,$]+\s+from\s+)['\"]([^'\"\n]+)['\"]"
JS_CALL = r"(?:^|[^\w$.])([A-Za-z_$][\w$]{2,})\s*\("
PY_IMPORT = r"(?m)^\s*(?:from\s+(\.*[\w.]*)\s+import\b|import\s+([\w.]+))"
UPPER_LITERAL = r"['\"]([A-Z][A-Z0-9_]{2,30})['\"]"
JS_ENV = r"process\.env\.([A-Z_][A-Z0-9_]*)"
PY_ENV = r"os\.(?:environ\.get|getenv)\(\s*['\"]([A-Z_][A-Z0-9_]*)['\"]|os\.environ\[\s*['\"]([A-Z_][A-Z0-9_]*)['\"]"
FLAG = r"(?<![\w-])--([a-z][a-z0-9]*(?:-[a-z0-9]+)*)\b"
ENUM_BLOCK = r"\benum\s+([A-Za-z_]\w*)\s*\{([^}]*)\}"
JS_KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "import", "constructor")
JS_ENDINGS = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx")
# End of fixed values.

_PY_SCHEMA = "path string, what string, name string, kind string, line int, end_line int"


def _python_rows(path: str, text: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(path, "error", None, None, None, None)]
    out = []
    todo = [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        inner = depth
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append((path, "symbol", node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno))
            inner = depth + 1
            for base in getattr(node, "bases", ()):
                if isinstance(base, (ast.Name, ast.Attribute)):
                    out.append((path, "extends", getattr(base, "id", None) or base.attr, node.name, node.lineno, None))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and depth == 0:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    out.append((path, "symbol", target.id, "var", node.lineno, node.end_lineno))
        elif isinstance(node, ast.Call):
            name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
            if name:
                out.append((path, "ref", name, "call", node.lineno, None))
        elif isinstance(node, ast.Import):
            out += [(path, "import", a.name, a.asname, node.lineno, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((path, "import", "." * node.level + (node.module or ""), ",".join(a.name for a in node.names), node.lineno, None))
        elif isinstance(node, ast.If):
            guarded = [c for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)]
            out += [(path, "guarded", c.func.id, ast.unparse(node.test)[:200], c.lineno, None) for c in guarded]
        todo += [(child, inner) for child in ast.iter_child_nodes(node)]
    return out


def _index_python(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _PY_SCHEMA.split(", ")]
    for pdf in batches:
        rows = [r for path, text in zip(pdf["path"], pdf["text"]) for r in _python_rows(path, text)]
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"line": "Int32", "end_line": "Int32"})


def index_python(texts: DataFrame) -> DataFrame:
    """(path, what, name, kind, line, end_line) of Python texts: symbol, ref, import, extends and guarded rows from the syntax tree.

    A text that can't be parsed gives one `error` row, and is left to the patterns. Rows are one per place.
    """
    return texts.where("text is not null").select("path", "text").mapInPandas(_index_python, _PY_SCHEMA)


def lines(texts: DataFrame) -> DataFrame:
    """(path, line, text) of each line, from 1."""
    return texts.where("text is not null").select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("path", F.col("line") + 1, "text").toDF("path", "line", "text")


def matches(texts: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """(path, name) of all matches of a group of a pattern, as often as they come."""
    return texts.where("text is not null").select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("name"))


def js_calls(texts: DataFrame) -> DataFrame:
    """(path, name, calls) of names that are called, without words of the language."""
    return matches(texts, JS_CALL).where(~F.col("name").isin(*JS_KEYWORDS)).groupBy("path", "name").agg(F.count("*").alias("calls"))


def tokens(texts: DataFrame) -> DataFrame:
    """(path, name): distinct UPPER_SNAKE literals per file."""
    return matches(texts, UPPER_LITERAL).distinct()


def enum_shapes(texts: DataFrame) -> DataFrame:
    """(path, name, members): enum blocks with their sorted distinct members."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(ENUM_BLOCK), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(ENUM_BLOCK), F.lit(2)).alias("b"))
    found = texts.where("text is not null").select("path", F.explode(both).alias("x"))
    members = F.filter(F.transform(F.split("x.b", r"[,;\n]"), lambda m: F.regexp_extract(m, r"^\s*([A-Za-z_]\w*)", 1)), lambda m: m != "")
    return found.select("path", F.col("x.n").alias("name"), F.array_sort(F.array_distinct(members)).alias("members"))


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, hits, files): places of each name (name) as a whole word in all texts.

    Words are counted per text first, so one pass serves any number of names and only counts are shuffled.
    """
    words = texts.where("text is not null").select("path", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("name"))
    counts = words.groupBy("path", "name").agg(F.count("*").alias("n")).join(names.select("name").distinct(), "name", "left_semi")
    return counts.groupBy("name").agg(F.sum("n").alias("hits"), F.count("*").alias("files"))


def implicit_usage(structured: Column, text: Column, gap: int = 5, ratio: float = 1.25) -> Column:
    """Whether texts have so many more places than references that some usage must be implicit."""
    return (text - structured >= gap) & (text > 0) & (text >= structured * F.lit(ratio))


def resolve_relative(imports: DataFrame, files: DataFrame, endings: tuple[str, ...] = JS_ENDINGS) -> DataFrame:
    """(path, spec, dst) of imports (path, spec) that begin with a dot: the first indexed candidate in the order of endings, null if none is."""
    asked = imports.where(F.col("spec").startswith(".")).select("path", "spec").distinct()
    base = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rest = F.regexp_replace("spec", r"^(?:\./)+", "")
    ups = F.size(F.regexp_extract_all(rest, F.lit(r"(?:^|/)(\.\.)(?=/|$)"), F.lit(1)))
    parts = F.filter(F.split(base, "/"), lambda p: p != "")
    stem = F.array_join(F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(0))), F.filter(F.split(rest, "/"), lambda p: ~p.isin("..", ".", ""))), "/")
    rewritten = F.regexp_replace(stem, r"\.[mc]?js$", "")
    options = F.array(*(F.concat(stem, F.lit(e)) for e in endings), *(F.when(stem != rewritten, F.concat(rewritten, F.lit(e))) for e in (".ts", ".tsx", ".d.ts")))
    candidates = asked.select("path", "spec", F.posexplode(options).alias("rank", "dst")).where("dst is not null")
    known = candidates.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy("path", "spec").agg(F.min(F.struct("rank", "dst"))["dst"].alias("dst"))
    return asked.join(known, ["path", "spec"], "left")


def mask(text: str, hash_comments: bool, strings: bool) -> str:
    """The text with comments, and strings if asked, blanked; its length and its lines stay."""
    comments = r"#[^\n]*" if hash_comments else r"/\*.*?(?:\*/|\Z)|//[^\n]*"
    literals = r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"

    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m.group()) if m.lastgroup == "c" or strings else m.group()

    return re.sub(rf"(?P<c>{comments})|(?P<l>{literals})", blank, text, flags=re.S)


def masked(path: Column, text: Column, strings: bool) -> Column:
    """mask of each text; files of languages with hash comments by their extension."""

    @pandas_udf("string")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t, str(p).rsplit(".", 1)[-1] in ("py", "rb", "sh", "yml", "yaml", "toml"), strings) for p, t in zip(paths, texts)])

    return run(path, text)


def contracts(texts: DataFrame) -> DataFrame:
    """(path, kind, name, sites): environment variables and flags that code reads, outside comments (flags: and strings)."""
    code = texts.where("text is not null").select("path", masked(F.col("path"), F.col("text"), False).alias("c"), masked(F.col("path"), F.col("text"), True).alias("b"))
    found = [
        code.select("path", F.lit("env").alias("kind"), F.explode(F.regexp_extract_all("b", F.lit(JS_ENV), F.lit(1))).alias("name")),
        code.select("path", F.lit("env").alias("kind"), F.explode(F.concat(F.regexp_extract_all("c", F.lit(PY_ENV), F.lit(1)), F.regexp_extract_all("c", F.lit(PY_ENV), F.lit(2)))).alias("name")),
        code.select("path", F.lit("flag").alias("kind"), F.explode(F.regexp_extract_all("b", F.lit(FLAG), F.lit(1))).alias("name")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).where("name <> ''").groupBy("path", "kind", "name").agg(F.count("*").alias("sites"))


def entrypoints(texts: DataFrame) -> DataFrame:
    """(path, kind): files that run by themselves, by a main guard or by their name."""
    guard = F.col("text").rlike(r"(?m)^if\s+__name__\s*==\s*['\"]__main__['\"]") | F.col("text").rlike(r"(?m)^func\s+main\s*\(\s*\)") | F.col("text").rlike(r"public\s+static\s+void\s+main\s*\(")
    kind = F.when(F.col("path").rlike(r"(^|/)(__main__\.py|main\.(py|go|c|js|ts)|cli\.py|index\.(js|ts))$"), "name").when(guard, "guard")
    return texts.where("text is not null").select("path", kind.alias("kind")).where("kind is not null")


def unresolved_kind(dst: Column) -> Column:
    """What kind of import a `module:` node is."""
    name = F.regexp_replace(dst, "^module:", "")
    return F.when(name.rlike(r"^<.*>$|\.h(pp)?$"), "external_include").when(name.startswith("."), "repo_relative").when(name.startswith("/"), "root_import").otherwise("module")


def comment_only(line: Column) -> Column:
    return F.coalesce(line.rlike(r"^\s*(#|//|/\*|\*|--)"), F.lit(False))
