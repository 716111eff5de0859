"""Problem 5: generated, minified and vendored source files, and data kept as code.

Each file is lexed and laid out anew in a canonical way: one statement, brace or element a line,
indented by depth. The original is compared with that layout. A file whose canonical form has many
times its lines was minified or bundled; one that is almost only literals is data; one that equals
its canonical form line by line and repeats the same shapes of lines throughout was written by a tool.

Layout can't tell who wrote a well-formatted file, so a file's own statement decides there: a comment
before the first or after the last piece of code that says a tool made the file, or that names a
project other than the repository where it speaks of rights, releases or maintainers. Comments in
between, and strings, tell nothing about the file. What remains is the path: directories that
builds write and those that hold other projects, and names with a version or a digest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MINIFIED_EXPANSION = 4.0  # canonical lines for each line of the file
MINIFIED_LINE = 200  # characters a line on average
DATA_SHARE = 0.5  # of the characters outside comments and white space are literals
DATA_WORDS = 0.1  # words outside literals, for each literal, at most
DATA_CHARACTERS = 200  # of literals at least
UNIFORM_LINES = 40  # a file of fewer lines repeats nothing
UNIFORM_SHAPES = 0.05  # different shapes of lines, for each line, at most
NAMES = ("generated", "minified", "vendored", "data")

_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_NUMBER = r"(?<![\w$])(?:0[xX][\da-fA-F_]+|\d[\w.]*)"
_SLASH = re.compile(
    rf"(?P<c>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<l>{_STRINGS}|`(?:\\.|[^`\\])*`|{_NUMBER}|(?<=[=(,:;!&|?\[{{}}])[ ]?/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)|(?P<w>[^\W\d][\w$]*|\$[\w$]*)|(?P<p>[^\w\s])",
    re.S,
)
_HASH = re.compile(rf"(?P<c>#[^\n]*)|(?P<l>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|{_STRINGS}|{_NUMBER})|(?P<w>[^\W\d]\w*)|(?P<p>[^\w\s])", re.S)

# What a comment says of its file: an optional subject, then that a tool made it.
_MADE = r"(?:generated|created|produced|written|emitted|compiled|built|made)"
_TOOL = re.compile(
    r"@generated\b|</?auto-?generated\b|auto-?generated(?:\s+(?:file|code|by|from)\b|\W*$)"
    rf"|(?:(?:this|the)\s+)?(?:(?:source\s+)?(?:file|code|module)\s+)?(?:(?:is|was|has\s+been)\s+)?(?:auto(?:matically)?|machine|mechanically)[\s-]*{_MADE}\b"
    rf"|(?:(?:this|the)\s+)?(?:source\s+)?(?:file|code|module)\s+(?:(?:is|was|has\s+been)\s+)?{_MADE}\s+(?:by|from|with|using)\b"
    r"|generated\s+(?:by|from|with|using)\s+\S"
    rf"|{_MADE}\s+by\s+(?:the\s+)?\S+\s+(?:compiler|generator|tool|script)\b"
    r"|(?:please\s+)?(?:do\s+not|don't|never)\s+(?:edit|modify|change)\b|(?:manual|hand|local)\s+(?:changes|edits)\s+(?:will|are|get)\b",
    re.I,
)
_RIGHTS = re.compile(r"copyright|\(c\)|©|licen[cs]|maintain|contributors|authors\b|upstream|\brelease\b|@preserve|\bpart of\b|^\S+ (?:- )?v?\d+(?:\.\d+)+", re.I)
#: Words of statements about rights and releases, and names of licences; whatever else stands there is a name.
_RIGHTS_WORDS = frozenset(
    "a all also an and any are as at author authors be by c code conditions contributor contributors copied copy copyright distributed do file files following for free from full granted has have help holder holders in information is it its kept library "
    "licence licenced licences license licensed licenses maintained maintainer maintainers may met modification modifications modified module most must no not notes notice of on open or original other our part permission permissive permitted please preserve "
    "project provided publish published redistribution release released releases repository reserved rest rights same see software some source team terms that the their these this to under unmodified unchanged up upstream use used v version was we were "
    "which with without you your forms form binary apache bsd cc gpl isc lgpl mit mpl agpl unlicense public domain spdx identifier note".split()
)
_NAME = re.compile(r"[A-Za-z][\w.-]*\w|[A-Za-z]")
_MARK = re.compile(r"^[\s/*#!;<-]*?(?=@|</?auto|[\w(©])")
_VENDOR_DIRS = frozenset("vendor vendors _vendor third_party third-party thirdparty 3rdparty external externals deps node_modules bower_components".split())
_BUILD_DIRS = frozenset("gen generated __generated__ autogen out build target".split())
_TOOL_NAME = re.compile(r"\.gen\.|[._]generated\.|\.pb\.|_pb2(?:_grpc)?\.|\.pb-c\.|\.g\.\w+$|(?:^|[.-])lock\.")
_SMALL_NAME = re.compile(r"[.-](?:min|bundle|chunk)\.\w+$|\.(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{6,}\.(?:js|mjs|css)$")
_VERSION = re.compile(r"v?\d+\.\d+(?:\.\d+)+")
_VERSIONED_NAME = re.compile(r".-v?\d+(?:\.\d+)+\.\w+$")


class Layout:
    """The tokens of a text and its two layouts: lines as they are and lines as the canonical form has them."""

    def __init__(self, text: str, lang: str | None) -> None:
        self.text, self.lang = text, lang
        self.comments: list[tuple[int, str]] = []
        self.tokens: list[tuple[str, int, int]] = []  # kind, start, end
        for m in (_HASH if lang == "python" else _SLASH).finditer(text):
            if m.lastgroup == "c":
                self.comments.append((m.start(), m.group()))
            else:
                self.tokens.append((m.lastgroup, m.start(), m.end()))
        self.lines = sum(1 for x in text.split("\n") if x.strip()) or 1
        self._lay()

    def _lay(self) -> None:
        """Index of the token that begins each line, canonical (with its depth) and as written."""
        text, brackets = self.text, 0
        self.canonical: list[tuple[int, int]] = []
        self.written: list[int] = []
        stack: list[str] = []
        fresh, python, data, last = True, self.lang == "python", self.lang == "json", -1
        for i, (kind, start, end) in enumerate(self.tokens):
            line_break = last < 0 or "\n" in text[last:start]
            if line_break:
                self.written.append(i)
            mark = text[start] if kind == "p" else ""
            if line_break and not python and not data and last > 0 and (not stack or stack[-1] == "{") and (text[last - 1] in ")]}\"'`" or text[last - 1].isalnum()):
                fresh = True  # a statement may end with its line
            if mark in ("}", "]", ")") and mark:
                if stack:
                    stack.pop()
                brackets = sum(x == "(" for x in stack) if mark == ")" else brackets
                fresh = fresh or (mark == "}" and not python) or (data and mark == "]")
            if fresh or (python and line_break and not stack):
                self.canonical.append((i, len(stack)))
                fresh = False
            if mark in ("{", "[", "(") and mark:
                stack.append(mark)
                brackets += mark == "("
                fresh = (mark == "{" and not python) or (data and mark == "[")
            elif mark == ";":
                fresh = not brackets
            elif mark == "}" and not python:
                fresh = not data and text[end : end + 1] not in (",", ")", ";", ".", "(")
            elif mark == ",":
                fresh = data or (bool(stack) and stack[-1] != "(" and not python)
            last = end

    def emit(self) -> str:
        """The canonical form."""
        out = []
        for (i, depth), (j, _) in zip(self.canonical, [*self.canonical[1:], (len(self.tokens), 0)]):
            out.append("  " * depth + " ".join(self.text[a:b] for _, a, b in self.tokens[i:j]))
        return "\n".join(out)

    @property
    def expansion(self) -> float:
        return len(self.canonical) / self.lines

    @property
    def uniformity(self) -> float:
        """Share of the lines of both layouts that begin at the same tokens, 1 for a file that is its canonical form."""
        ours, theirs = {i for i, _ in self.canonical}, set(self.written)
        return len(ours & theirs) / len(ours | theirs) if ours | theirs else 1.0

    @property
    def shapes(self) -> float:
        """Different sequences of kinds and marks, for each line as written."""
        seen = set()
        for i, j in zip(self.written, [*self.written[1:], len(self.tokens)]):
            seen.add("".join(k if k != "p" else self.text[a] for k, a, _ in self.tokens[i:j]))
        return len(seen) / len(self.written) if self.written else 1.0

    @property
    def literals(self) -> tuple[int, int, int, float]:
        """(literals, their characters, words, share of literals in all characters of tokens)."""
        count = size = words = total = 0
        for kind, a, b in self.tokens:
            total += b - a
            count += kind == "l"
            size += (b - a) if kind == "l" else 0
            words += kind == "w"
        return count, size, words, size / total if total else 0.0

    def edge_comments(self) -> Iterator[str]:
        """Lines of the comments before the first and after the last token, without their marks."""
        first, last = (self.tokens[0][1], self.tokens[-1][1]) if self.tokens else (len(self.text), -1)
        for at, comment in self.comments:
            if at < first or at > last:
                for line in comment.split("\n"):
                    yield _MARK.sub("", line.strip().rstrip("*/ "), 1)


def said(lines: Iterator[str], repository: str) -> str | None:
    """What the comments say of their file: `generated`, `vendored`, or nothing."""
    foreign = False
    for line in lines:
        if _TOOL.match(line):
            return "generated"
        if _RIGHTS.search(line):
            names = {w.lower() for w in _NAME.findall(line)} - _RIGHTS_WORDS
            names = {w for w in names if not _VERSION.fullmatch(w)}
            foreign = foreign or (bool(names) and repository not in names)
    return "vendored" if foreign else None


def by_path(path: str) -> str | None:
    """What the path tells."""
    *dirs, name = path.split("/")
    dirs = dirs[1:]
    if _VENDOR_DIRS.intersection(dirs) or any(_VERSION.fullmatch(x) for x in dirs) or _VERSIONED_NAME.search(name):
        return "vendored"
    if _BUILD_DIRS.intersection(dirs) or _TOOL_NAME.search(name):
        return "generated"
    return "minified" if _SMALL_NAME.search(name) else None


def _json_says(text: str) -> bool:
    """Whether a JSON object has a member of its own, at whatever place, that names its generator."""
    return any(m.group(1) for m in _members(text) if re.fullmatch(r"[_@]*generated(?:_?by)?", m.group(1)[1:-1], re.I))


def _members(text: str) -> Iterator[re.Match]:
    depth = 0
    for m in re.finditer(r"(\"(?:\\.|[^\"\\])*\")(?=\s*:)|\"(?:\\.|[^\"\\])*\"|[{}\[\]]", text):
        if m.group() in ("{", "["):
            depth += 1
        elif m.group() in ("}", "]"):
            depth -= 1
        elif depth == 1 and m.group(1):
            yield m


def judge(path: str, text: str, lang: str | None) -> tuple[str | None, float, float, float]:
    """(kind or None, expansion, uniformity, share of literals) of a text."""
    layout = Layout(text, lang)
    count, size, words, share = layout.literals
    expansion, uniformity = layout.expansion, layout.uniformity
    kind = None
    if lang == "json":
        kind = "generated" if _json_says(text) else None
    elif expansion >= MINIFIED_EXPANSION and len(text) / layout.lines >= MINIFIED_LINE:
        kind = "minified"
    elif lang != "css" and share >= DATA_SHARE and size >= DATA_CHARACTERS and words <= max(count * DATA_WORDS, 24):
        kind = "data"
    elif uniformity == 1.0 and layout.lines >= UNIFORM_LINES and layout.shapes <= UNIFORM_SHAPES:
        kind = "generated"
    kind = kind or said(layout.edge_comments(), path.split("/", 1)[0].lower()) or by_path(path)
    return kind, expansion, uniformity, share


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [judge(path, text, lang) if text else (by_path(path), 0.0, 1.0, 0.0) for path, text, lang in zip(pdf["path"], pdf["text"], pdf["lang"])]
        out = pd.DataFrame(rows, columns=["kind", "expansion", "uniformity", "literal_share"])
        out.insert(0, "path", pdf["path"].to_numpy())
        yield out


def file_origins(rows: DataFrame) -> DataFrame:
    """(path, kind, expansion, uniformity, literal_share) of rows (path, text, lang) with a non-null text.

    kind is `generated`, `minified`, `vendored`, `data`, or null for hand-written files. An empty text
    is judged by its path. Texts are read whole, a null lang counts as one with slash comments. Rows
    repeat as they come; other columns are ignored. No shuffle.
    """
    return rows.where("path is not null and text is not null").select("path", "text", "lang").mapInPandas(_run, "path string, kind string, expansion double, uniformity double, literal_share double")
