"""File trees as relations: listing, ignore rules, hashes, decoding."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from codelode.functions.paths import ancestors, glob_regex, matches_any

# Directories that are never looked into, extensions and first lines by language.
SKIP_DIRS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".cache", ".tox", ".mypy_cache")
LANG_BY_EXTENSION = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "rs": "rust", "rb": "ruby", "json": "json", "css": "css", "md": "markdown", "toml": "toml", "yml": "yaml", "yaml": "yaml", "sh": "shell",
}
SHEBANGS = {"python": "python", "python3": "python", "node": "javascript", "bash": "shell", "sh": "shell", "perl": "perl", "ruby": "ruby"}
CPP_HEADER = r"(?m)^\s*(class\s+\w+|namespace\s+\w*|template\s*<|public:|private:)|\bstd::"
# End of fixed values.

MAX_BYTES = 3_000_000


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content) of all files below root; path is relative. content is read only if it is used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    return df.select(F.expr(f"substring(path, instr(path, '{prefix}') + {len(prefix)})").alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), "content")


def kept(path: Column, include: list[str], exclude: list[str], exclude_wins: bool = False) -> Column:
    """Whether a listing keeps a path: not in skipped or hidden directories, and by patterns; an include beats an exclude unless exclude_wins."""
    skipped = F.exists(ancestors(path), lambda d: F.regexp_extract(d, r"([^/]*)/$", 1).isin(*SKIP_DIRS) | F.regexp_extract(d, r"([^/]*)/$", 1).startswith("."))
    inside, outside = matches_any(path, include), matches_any(path, exclude)
    if exclude_wins:
        by_pattern = ~outside & (inside if include else F.lit(True))
    else:
        by_pattern = inside if include else ~outside
    return ~skipped & by_pattern


def oversize(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    return files.where(F.col("size") > most)


def language(path: Column, first_line: Column | None = None) -> Column:
    """By extension, else by the program or the mode that the first line names, else `other`."""
    out = F.create_map(*(F.lit(x) for pair in LANG_BY_EXTENSION.items() for x in pair))[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]
    if first_line is not None:
        program = F.regexp_extract(first_line, r"^#!.*?([A-Za-z]+\d?)[\d.]*(?:\s+-\S*)*\s*$", 1)
        mode = F.lower(F.regexp_extract(first_line, r"-\*-\s*(?:mode:\s*)?([\w+-]+)", 1))
        by_line = F.create_map(*(F.lit(x) for pair in SHEBANGS.items() for x in pair))
        out = F.coalesce(out, by_line[program], by_line[mode])
    return F.coalesce(out, F.lit("other"))


def header_language(path: Column, text: Column) -> Column:
    """cpp for headers with marks of C++, else c; null for other files."""
    return F.when(path.endswith(".h"), F.when(text.rlike(CPP_HEADER), "cpp").otherwise("c"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that aren't are replaced."""

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else bytes(v).decode("utf-8", "replace") for v in values])

    return run(content)


def parse_ignore(text: str) -> list[tuple[str, bool, bool, bool]]:
    """Rules (pattern, negate, dir_only, anchored) of an ignore file, in order; blank lines and comments are none."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        line = line[1:] if line.startswith("\\#") else line
        negate = line.startswith("!")
        line = line[negate:]
        anchored = line.startswith("/")
        line = line[anchored:]
        dir_only = line.endswith("/")
        line = line[: len(line) - dir_only]
        if line:
            rules.append((line, negate, dir_only, anchored))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool, bool, bool]]) -> Column:
    """Whether the last rule that matches a path, or a directory above it, ignores it."""

    def hit(pattern: str, dir_only: bool, anchored: bool) -> Column:
        body = glob_regex(pattern.replace("**/", "").replace("/**", "/*"))[len("(?s)^") : -len(r"\z")]
        start = "^" if anchored else "(^|/)"
        return path.rlike(f"(?s){start}{body}/") if dir_only else path.rlike(f"(?s){start}{body}(/|\\z)")

    # the last match wins, so rules are asked from the end
    steps = [(hit(p, d, a), not negate) for p, negate, d, a in reversed(rules)]
    if not steps:
        return F.lit(False)
    chain = functools.reduce(lambda c, s: c.when(s[0], F.lit(s[1])), steps[1:], F.when(steps[0][0], F.lit(steps[0][1])))
    return F.coalesce(chain.otherwise(False), F.lit(False))
