"""Lexers of the languages that syntax.py parses: text to terminals of the grammar, with their places."""

from __future__ import annotations

import re


class LexError(Exception):
    """No token begins at this place."""

    def __init__(self, at: int) -> None:
        super().__init__(at)
        self.at = at


Tokens = tuple[list[str], list[int]]

# ---------------------------------------------------------------- JSON

_JSON = re.compile(
    r"[ \t\r\n]+|(?P<STRING>\"(?:[^\"\\\x00-\x1f]|\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4})*\")|(?P<NUMBER>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<o>[{}\[\],:]|true\b|false\b|null\b)", re.A
)


def lex_json(text: str) -> Tokens:
    kinds, places, at, n = [], [], 0, len(text)
    match = _JSON.match
    while at < n:
        m = match(text, at)
        if not m:
            raise LexError(at)
        kind = m.lastgroup
        if kind:
            kinds.append(m.group() if kind == "o" else kind)
            places.append(at)
        at = m.end()
    return kinds, places


# ---------------------------------------------------------------- CSS

_CSS = re.compile(r"\s+|/\*.*?\*/|(?P<brace>[{};])|(?P<piece>(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|/\*.*?\*/|url\([^)\n]*\)|\\.|[^{};\"'\\/]|/(?!\*))+)", re.S)
_DECL = re.compile(r"(?:--)?[-\w]+\s*:\s*\S.*|[*_]?[-\w]+\s*:\s*\S.*|--[-\w]+\s*:\s*", re.S)
# What is taken isn't given back, so a text that is no selector is told in one pass.
_SIMPLE = r"(?>\d+(?:\.\d+)?%|(?:[\w*|-]|\\.|[^\x00-\x7f])*+(?:[#.](?:[\w-]|\\.|[^\x00-\x7f])++|::?[\w-]++(?:\((?:[^()]|\([^()]*\))*+\))?|\[[^\]]*+\]|&)*+)"
_SELECTOR = re.compile(rf"[>+~]? ?(?=\S){_SIMPLE}(?:(?> ?[>+~,] ?| )(?=\S){_SIMPLE})*+", re.S)


def _balanced(text: str) -> bool:
    depth = []
    for c in re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|/\*.*?\*/", "", text, flags=re.S):
        if c in "([":
            depth.append(c)
        elif c in ")]":
            if not depth or "([".index(depth.pop()) != ")]".index(c):
                return False
    return not depth


def lex_css(text: str) -> Tokens:
    pieces, at, n = [], 0, len(text)
    while at < n:
        m = _CSS.match(text, at)
        if not m:
            raise LexError(at)
        if m.lastgroup:
            pieces.append((at, m.group()))
        at = m.end()
    kinds, places = [], []
    for i, (at, piece) in enumerate(pieces):
        places.append(at)
        if piece in ("{", "}", ";"):
            kinds.append(piece)
            continue
        bare = re.sub(r"/\*.*?\*/", " ", piece, flags=re.S).strip()
        opens = i + 1 < len(pieces) and pieces[i + 1][1] == "{"
        good = _balanced(bare) and not re.search(r"^(?:<{7}|={7}|>{7})", bare, re.M)
        if bare.startswith("@"):
            kinds.append("PRELUDE" if opens else "AT")
        elif opens:
            kinds.append("PRELUDE" if good and _SELECTOR.fullmatch(" ".join(bare.split())) else "BAD")
        else:
            kinds.append("DECL" if good and _DECL.fullmatch(bare) and "\n\n" not in bare else "BAD")
    return kinds, places


# ---------------------------------------------------------------- Python

_PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY = re.compile(
    r"(?P<s>[ \t\f]+|\\\r?\n|\\\r|#[^\r\n]*)|(?P<nl>\r\n|\n|\r)"
    r"|(?P<STRING>(?:[rRbBuUfFtT]|[bB][rR]|[rR][bB]|[fFtT][rR]|[rR][fFtT])?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?!\"\")(?:\\(?:\r\n|.)|[^\"\\\r\n])*\"|'(?!'')(?:\\(?:\r\n|.)|[^'\\\r\n])*'))"
    r"|(?P<NUMBER>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![0-9_]|(?!(?:and|or|in|is|if|else|not|for)\b)[^\W\d]))"
    r"|(?P<n>[^\W\d]\w*)"
    r"|(?P<AUG>\*\*=|//=|>>=|<<=|[-+*/%@&|^]=)|(?P<o>\.\.\.|->|:=|\*\*|[-+*/()\[\]{},:.;~@=](?!=))|(?P<OP>//|<<|>>|<=|>=|==|!=|[%&|^<>])|(?P<e>=)",
    re.S,
)


def lex_python(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    add, put = kinds.append, places.append
    indents = [(0, 0)]
    depth, at, n, fresh = 0, 0, len(text), True
    opened: list[str] = []
    match = _PY.match
    if text.startswith("\ufeff"):
        at = 1
    while at < n:
        if fresh and not depth:
            start, col, alt = at, 0, 0
            while at < n and text[at] in " \t\f":
                if text[at] == " ":
                    col, alt = col + 1, alt + 1
                elif text[at] == "\t":
                    col, alt = (col // 8 + 1) * 8, alt + 1
                else:
                    col = alt = 0
                at += 1
            if at >= n:
                break
            if text[at] in "\r\n#":  # blank line: no tokens
                m = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)?").match(text, at)
                at = m.end()
                continue
            fresh = False
            if col > indents[-1][0]:
                if alt <= indents[-1][1]:
                    raise LexError(start)
                indents.append((col, alt))
                add("INDENT")
                put(at)
            else:
                while col < indents[-1][0]:
                    indents.pop()
                    add("DEDENT")
                    put(at)
                if (col, alt) != indents[-1]:
                    raise LexError(at)
            continue
        m = match(text, at)
        if not m:
            raise LexError(at)
        kind = m.lastgroup
        if kind == "n":
            word = m.group()
            add(word if word in _PY_WORDS else "NAME")
            put(at)
        elif kind == "o":
            mark = m.group()
            if mark in "([{":
                depth += 1
                opened.append(mark)
            elif mark in ")]}":
                if not opened or "([{".index(opened.pop()) != ")]}".index(mark):
                    raise LexError(at)
                depth -= 1
            add(mark)
            put(at)
        elif kind == "nl":
            if not depth:
                fresh = True
                if kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    add("NEWLINE")
                    put(at)
        elif kind == "e":
            add("=")
            put(at)
        elif kind != "s":
            if kind == "NUMBER" and text[at] == "0" and (digits := m.group().replace("_", "")).isdigit() and digits.strip("0"):
                raise LexError(at)
            add(kind)
            put(at)
        at = m.end()
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        add("NEWLINE")
        put(n)
    for _ in indents[1:]:
        add("DEDENT")
        put(n)
    if depth:
        raise LexError(n)
    _soft_words(text, kinds, places)
    return kinds, places


def _soft_words(text: str, kinds: list[str], places: list[int]) -> None:
    """match, case and type are words of the language where a statement of theirs begins."""
    for i, kind in enumerate(kinds):
        if kind != "NAME" or (i and kinds[i - 1] not in ("NEWLINE", "INDENT", "DEDENT", ";")):
            continue
        word = text[places[i] : places[i] + 5]
        if word.startswith("type ") and kinds[i + 1] == "NAME" and kinds[i + 2] in ("=", "["):
            kinds[i] = "type"
        elif (word == "match" or word.startswith("case")) and kinds[i + 1] not in ("=", ".", ",", ")", ":", "AUG", "NEWLINE", "OP"):
            j, depth = i + 1, 0
            while kinds[j] != "NEWLINE" and not (kinds[j] == ":" and not depth):
                depth += (kinds[j] in "([{") - (kinds[j] in ")]}")
                j += 1
            if kinds[j] == ":" and (word != "match" or kinds[j + 1 : j + 3] == ["NEWLINE", "INDENT"]) and re.match(r"(match|case)\b", text[places[i] :]):
                kinds[i] = "match" if word == "match" else "case"


_PY_OPERATORS = frozenset("AUG OP + - / ** @ and or not in is if lambda await -> :=".split())
_PY_VALUES = frozenset("NUMBER STRING None True False ... - + ~ not lambda await yield {".split())


def _python_target(kinds: list[str], low: int, high: int) -> int:
    """The index of the first token of kinds[low:high] that can't be part of a target of assignment, or -1."""
    piece, depth, opened = low, 0, -1
    for i in range(low, high + 1):
        k = kinds[i] if i < high else ","
        if k in ("(", "[", "{"):
            if not depth:
                opened = i
            depth += 1
        elif k in (")", "]", "}"):
            depth -= 1
        elif not depth and k == ",":
            if kinds[piece] == "*":
                piece += 1
            if piece < i:
                if kinds[piece] in _PY_VALUES:
                    return piece
                if kinds[i - 1] == ")" and opened > piece:
                    return opened
            piece = i + 1
        elif not depth and (k in _PY_OPERATORS or (k == "*" and i > piece)):
            return i
    return -1


def python_misuse(kinds: list[str]) -> int:
    """Index of the first token that the grammar allows but its place doesn't, or -1.

    These are targets that are values, return and yield outside functions, break and continue outside
    loops, and await outside asynchronous functions.
    """
    outer = [(False, False, False)]  # in a function, in a loop, asynchronous
    i, n = 0, len(kinds)
    while i < n:
        if kinds[i] == "INDENT":
            outer.append(here)  # noqa: F821 - a head comes before each indent
            i += 1
            continue
        if kinds[i] == "DEDENT":
            outer.pop()
            i += 1
            continue
        end = kinds.index("NEWLINE", i)
        here = outer[-1]
        head = kinds[i + 1] if kinds[i] == "async" else kinds[i]
        suite = end
        if head in ("def", "class", "for", "while", "if", "else", "elif", "try", "except", "finally", "with", "match", "case"):
            inside = (True, False, kinds[i] == "async") if head == "def" else (False, False, False) if head == "class" else (here[0], True, here[2]) if head in ("for", "while") else here
            if kinds[i] == "async" and head != "def" and not here[2]:
                return i
            depth, lambdas = 0, 0
            for j in range(i, end):
                k = kinds[j]
                depth += (k in ("(", "[", "{")) - (k in (")", "]", "}"))
                if not depth and k == "lambda":
                    lambdas += 1
                elif not depth and k == ":":
                    if not lambdas:
                        suite = j
                        break
                    lambdas -= 1
        starts, depth, has_lambda = i, 0, "lambda" in kinds[i:end]
        for j in range(i, end + 1):
            k = kinds[j]
            if j == suite and j < end:
                here, starts = inside, j + 1
            depth += (k in ("(", "[", "{")) - (k in (")", "]", "}"))
            if (k == "return" and not here[0]) or (k in ("break", "continue") and not here[1]) or (k == "await" and not here[2]) or (k == "yield" and not here[0] and not has_lambda):
                return j
            if not depth and (k == "=" or k == "AUG") and kinds[starts] not in ("type", "def", "class") and "lambda" not in kinds[starts:j]:
                colon = next((c for c in range(starts, j) if kinds[c] == ":" and kinds[starts:c].count("[") == kinds[starts:c].count("]") and kinds[starts:c].count("{") == kinds[starts:c].count("}")), j)
                bad = _python_target(kinds, starts, colon)
                if bad >= 0:
                    return bad
                starts = j + 1
            elif not depth and k == ";":
                starts = j + 1
        if suite < end:
            here = outer[-1]
        here = inside if suite == end - 1 else here
        i = end + 1
    return -1
