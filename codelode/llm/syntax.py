"""Problem 3: source files that don't parse in their language.

Each language has a grammar beside this module; LALR(1) tables are built from it once per process.
A file is lexed and its whole token stream is parsed; the first token that no valid file can have
there is its error. Names, types and imports play no part. Of the rules beyond the grammar only
those of Python about targets and the places of return, yield, await, break and continue count.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from codelode.llm import clike, lexers, script
from codelode.llm.lalr import Table
from codelode.llm.lexers import LexError

LANGUAGES: dict[str, tuple[str, Callable[[str], lexers.Tokens]]] = {
    "json": ("json", lexers.lex_json),
    "css": ("css", lexers.lex_css),
    "python": ("python", lexers.lex_python),
    "go": ("go", clike.lex_go),
    "java": ("java", clike.lex_java),
    "c": ("c", clike.lex_c),
}
SCRIPTS = {"javascript": False, "typescript": True}  # read token by token with the parser's state
GRAMMARS = frozenset(LANGUAGES) | frozenset(SCRIPTS)


_tables: dict[str, Table] = {}


def table(grammar: str) -> Table:
    """The automaton of a grammar; built once in a process, or handed over from the driver."""
    if grammar not in _tables:
        _tables[grammar] = Table(pkgutil.get_data(__package__, f"grammars/{grammar}.grammar").decode())
    return _tables[grammar]


def all_tables() -> dict[str, Table]:
    return {g: table(g) for g in {grammar for grammar, _ in LANGUAGES.values()} | {"script"}}


def first_error(text: str, lang: str) -> int:
    """Place of the first error (len(text): it ends too soon), or -1."""
    if lang in SCRIPTS:
        return script.first_error(table("script"), text, SCRIPTS[lang])
    grammar, lex = LANGUAGES[lang]
    parser = table(grammar)
    try:
        kinds, places = lex(text)
    except LexError as e:
        return e.at
    ids = parser.ids
    at = parser.first_error([ids.get(k, -1) for k in kinds])
    if at < 0 and lang == "python":
        at = lexers.python_misuse(kinds)
    return at if at < 0 else places[at] if at < len(places) else len(text)


def _parser(handed: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not _tables:
            _tables.update(handed.value)
        for pdf in batches:
            errors = [first_error(t, g) if g in GRAMMARS else -1 for t, g in zip(pdf["text"], pdf["lang"])]
            lines = [t.count("\n", 0, e) + 1 if e >= 0 else None for t, e in zip(pdf["text"], errors)]
            yield pd.DataFrame({"path": pdf["path"], "lang": pdf["lang"], "parsed": [g in GRAMMARS for g in pdf["lang"]], "error_line": pd.array(lines, dtype="Int32")})

    return run


def parse_files(rows: DataFrame) -> DataFrame:
    """(path, lang, parsed, error_line) of rows (path, text, lang) with a non-null text.

    error_line is null for a valid file, and for a language without a grammar (parsed is false). An
    empty text is valid but for JSON. Texts are parsed whole, whatever their length. Rows repeat as
    they come. No shuffle.
    """
    rows = rows.where("path is not null and text is not null").select("path", "text", "lang")
    # the automata depend on the grammars alone, a few megabytes; workers need not build them again
    handed = rows.sparkSession.sparkContext.broadcast(all_tables())
    return rows.mapInPandas(_parser(handed), "path string, lang string, parsed boolean, error_line int")


def broken_files(rows: DataFrame) -> DataFrame:
    """(path) of files that don't parse, each once."""
    return parse_files(rows).where("error_line is not null").select("path").distinct()


def broken_rates(rows: DataFrame) -> DataFrame:
    """(repository, lang, files, broken, rate) of the files that were parsed; a repository is the first segment of a path."""
    parsed = parse_files(rows).where("parsed")
    groups = parsed.groupBy(F.split("path", "/")[0].alias("repository"), "lang")
    return groups.agg(F.count("*").alias("files"), F.count("error_line").alias("broken")).withColumn("rate", F.round(F.col("broken") / F.col("files"), 4))
