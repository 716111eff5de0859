"""JavaScript modules and TypeScript for syntax.py: the parser's state says what a mark or word means.

A slash, a brace, a bracket before an arrow and many words can be several terminals. They are offered
in a fixed order and the first that the state allows is taken, so the reader needs no guesses about
what came before. Missing semicolons are filled in by the rules of the language; an AUTO terminal of
its own keeps them out of empty statements and heads of loops.
"""

from __future__ import annotations

import re

from codelode.llm.lalr import Table

_WORDS = frozenset("await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof let new null return super switch this throw true try typeof var void while with yield".split())
_TOKEN = re.compile(
    r"(?P<STRING>\"(?:\\(?:\r\n|.)|[^\"\\\r\n])*\"|'(?:\\(?:\r\n|.)|[^'\\\r\n])*')"
    r"|(?P<NUMBER>(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|(?:0|[1-9](?:_?\d)*)n)(?![\w$]))"
    r"|(?P<n>(?:[^\W\d]|[$]|\\u[\da-fA-F]{4})(?:[\w$‌‍]|\\u[\da-fA-F]{4})*)|(?P<PRIVATE>#(?:[^\W\d]|[$])[\w$]*)"
    r"|(?P<ASSIGN>>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|[-+*%&|^]=)|(?P<UPDATE>\+\+|--)"
    r"|(?P<OP>\*\*|===|!==|==|!=|<=|>=|<<|>>>|>>|&&|\|\||\?\?|[%^])|(?P<o>\.\.\.|=>|\?\.(?!\d)|[-+*(){}\[\],.;:?~@!=<>&|/`])",
    re.S,
)
_SPACE = re.compile(r"(?:[^\S\r\n  ]+|//[^\r\n  ]*|(?P<nl>[\r\n  ])|/\*(?P<c>.*?)\*/)", re.S)
_LINE = re.compile(r"[\r\n  ]")
_REGEX = re.compile(r"/(?![*/])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\r\n\[])+/[\w$]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{)", re.S)
_HASHBANG = re.compile(r"#![^\n]*")
#: Comments and white space on one line.
_GAP = r"(?:[^\S\r\n]|/\*[^\r\n]*?\*/)*"
_MEMBER_NEXT = re.compile(_GAP + r"[\w$\"'\[#*\\]")
_WORD_NEXT = re.compile(_GAP + r"(?!(?:in|of|instanceof|as|satisfies|extends)\b)[A-Za-z_$\u0080-￿]")
_HEAD_NEXT = re.compile(_GAP + r"[\w$\"'{\[]")
_ASYNC_NEXT = re.compile(_GAP + r"(?:(function)\b|([A-Za-z_$][\w$]*)\s*=>|(\()|(<))")
_OPT_NEXT = re.compile(r"\s*(?:[:),;\]}]|=(?![=>]))")
_SKIP = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|=>|[()\[\]{}<>;=&|+*%^!?-]", re.S)
_ARROW = re.compile(r"\s*=>")
_RESULT = re.compile(r"\s*:")
_AFTER_ANGLE = re.compile(r"\s*(?:[(),;:.?!\[\]{}=&|`]|extends\b|implements\b|\Z|[\r\n])")
_BRACES = ("B{", "C{", "I{", "E{", "S{", "O{")
_OPERATOR_WORDS = {"as": "as", "satisfies": "as"}
_MODS = {False: frozenset("static get set async accessor".split()), True: frozenset("static get set async accessor public private protected readonly override abstract declare".split())}
_STARTS = {"interface": "interface", "type": "type", "namespace": "namespace", "module": "namespace", "declare": "declare", "abstract": "abstract", "enum": "enum"}
_TYPE_WORDS = {"keyof": "TYPEOP", "unique": "TYPEOP", "readonly": "TYPEOP", "infer": "infer", "asserts": "asserts"}


def closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at this place, or -1; strings and comments are skipped."""
    depth = 0
    for m in _SKIP.finditer(text, at):
        mark = m.group()
        if mark in ("(", "[", "{"):
            depth += 1
        elif mark in (")", "]", "}"):
            depth -= 1
            if not depth:
                return m.end()
    return -1


def _angle_end(text: str, at: int) -> int:
    """End of type arguments <...> that begin at this place, or -1 where it is a comparison."""
    angles, others = 0, 0
    for m in _SKIP.finditer(text, at):
        mark = m.group()
        if mark == "<":
            angles += 1
        elif mark == ">":
            angles -= 1
            if not angles:
                return m.end() if not others else -1
        elif mark in ("(", "[", "{"):
            others += 1
        elif mark in (")", "]", "}"):
            others -= 1
            if others < 0:
                return -1
        elif not others and (mark in (";", "=", "+", "*", "%", "^", "!") or text.startswith(("&&", "||"), m.start())):
            return -1
    return -1


def _result_type(text: str, at: int) -> bool:
    """Whether the colon at this place stands before the result type of an arrow function."""
    need = 1
    first = re.compile(r"\s*").match(text, at + 1).end()
    if text[first : first + 1] == "(":  # a function type has an arrow of its own, and so has a function
        end = closing(text, first)
        if end > 0 and _ARROW.match(text, end):
            need = 2
    depth = 0
    for m in _SKIP.finditer(text, first):
        mark = m.group()
        if mark == "=>":
            if not depth:
                need -= 1
                if not need:
                    return True
        elif mark in ("(", "[", "{", "<"):
            depth += 1
        elif mark in (")", "]", "}", ">"):
            depth -= 1
            if depth < 0:
                return False
        elif not depth and mark in (";", "=", "+", "*", "%", "^", "!", "?"):
            return False
    return False


class Reader:
    """One pass over a text with the automaton of script.grammar."""

    def __init__(self, table: Table, text: str, typescript: bool) -> None:
        self.table, self.text, self.ts = table, text, typescript
        self.ids = table.ids
        self.stack = [0]
        self.last = ""

    def can(self, kind: str) -> bool:
        token = self.ids.get(kind)
        return token is not None and self.table.accepts_next(self.stack, token)

    def shift(self, kind: str) -> bool:
        """Takes a terminal if it can follow."""
        token = self.ids.get(kind)
        if token is None or not self.table.feed(self.stack, token):
            return False
        self.last = kind
        return True

    def first_error(self) -> int:
        text, n, can, shift = self.text, len(self.text), self.can, self.shift
        at, line = 0, False
        braces: list[bool] = []  # whether an open brace is that of a template
        if text.startswith("﻿"):
            at = 1
        m = _HASHBANG.match(text, at)
        if m:
            at = m.end()
        space, token = _SPACE.match, _TOKEN.match
        while True:
            m = space(text, at)
            while m:
                if m.group("nl") or (m.group("c") and _LINE.search(m.group("c"))):
                    line = True
                at = m.end()
                m = space(text, at)
            if at >= n:
                if not can("$"):
                    self.fill()
                return -1 if can("$") else n
            m = token(text, at)
            if not m:
                return at
            kind, end, mark = m.lastgroup, m.end(), m.group()
            if line and self.last in ("return", "break", "continue") and can("AUTO"):
                shift("AUTO")
            elif line and self.last == "throw" or mark == "@" and not self.ts:
                return at
            if kind == "n":
                kind = self.word(mark, end, line)
            elif kind == "UPDATE":
                if line and can("AUTO"):
                    shift("AUTO")
            elif kind == "o":
                if mark == "{":
                    kind = next((k for k in _BRACES if can(k)), "")
                    if not kind and line and can("AUTO"):
                        shift("AUTO")
                        kind = next((k for k in _BRACES if can(k)), "")
                    if not kind:
                        return at
                    braces.append(False)
                elif mark == "}":
                    if not braces:
                        return at
                    if braces.pop():
                        m = _TEMPLATE.match(text, end)
                        if not m:
                            return at
                        kind, end = ("T)" if m.group(1) == "`" else "T,"), m.end()
                        if kind == "T,":
                            braces.append(True)
                    else:
                        kind = mark
                elif mark == "`":
                    m = _TEMPLATE.match(text, end)
                    if not m:
                        return at
                    kind, end = ("TEMPLATE" if m.group(1) == "`" else "T("), m.end()
                    if kind == "T(":
                        braces.append(True)
                elif mark == "/":
                    if can("/"):
                        kind, end = ("ASSIGN", end + 1) if text[end : end + 1] == "=" else ("/", end)
                    else:
                        m = _REGEX.match(text, at)
                        if not m:
                            return at
                        if line and not can("REGEX") and can("AUTO"):
                            shift("AUTO")
                        kind, end = "REGEX", m.end()
                elif self.ts:
                    kind = self.mark(mark, at, end, line)
                else:
                    kind = "OP" if mark in "<>&|" else mark
            elif self.ts and kind in ("OP", "ASSIGN") and mark[0] == ">" and can("TA>"):
                kind, end = "TA>", at + 1
            elif self.ts and mark == "||" and can("|"):
                return at
            if not shift(kind):
                if self.ts and (line or kind in (";", "}")):
                    shift("NOBODY")
                if not shift(kind):
                    if not (line or kind == "}") or not shift("AUTO"):
                        return at
                    if m.lastgroup == "n":
                        kind = self.word(mark, end, line)
                    if not shift(kind):
                        return at
            at, line = end, False

    def fill(self) -> None:
        """What may be missing at the end of a text."""
        if self.ts and self.can("NOBODY"):
            self.shift("NOBODY")
        elif self.can("AUTO"):
            self.shift("AUTO")

    def word(self, word: str, end: int, line: bool) -> str:
        text, can, ts = self.text, self.can, self.ts
        if word in _WORDS and not (word == "enum" and ts):
            if can(word):
                return word
            return "KEY" if can("KEY") else word
        if self.last in (".", "?."):
            return "NAME"
        if word in _MODS[ts] and can("MOD") and (_MEMBER_NEXT.match(text, end) or (word in ("public", "private", "protected", "readonly", "override") and _HEAD_NEXT.match(text, end))):
            return "MOD"
        if word == "static" and can("static") and re.compile(r"\s*\{").match(text, end):
            return "static"
        if word == "async":
            m = _ASYNC_NEXT.match(text, end)
            if m and can("async"):
                if m.group(1) or m.group(2):
                    return "async"
                if m.group(4):
                    return "async" if ts else "NAME"
                close = closing(text, m.start(3))
                if close > 0 and (_ARROW.match(text, close) or (ts and _RESULT.match(text, close) and _result_type(text, _RESULT.match(text, close).end() - 1))):
                    return "async"
            return "NAME"
        if word in ("of", "from", "as", "using") or (ts and word in ("satisfies", "implements", "is")):
            kind = _OPERATOR_WORDS.get(word, word)
            if word == "using":
                return "using" if can("using") and _WORD_NEXT.match(text, end) else "NAME"
            if word == "as" and not ts and not (can("as") and not can("OP")):
                return "NAME"
            if word in ("as", "satisfies") and line and can("AUTO"):
                return "NAME"
            if can(kind) and not (can("NAME") and word != "as"):
                return kind
            if word == "as" and can("as") and can("NAME"):
                return "as" if self.last in ("NAME", "KEY", "STRING", "*") else "NAME"
            return "NAME"
        if ts:
            kind = _STARTS.get(word)
            if kind and can(kind):
                if word in ("type", "interface", "namespace", "abstract") and _WORD_NEXT.match(text, end):
                    return kind
                if word == "type" and self.last in ("import", "export") and re.compile(_GAP + r"[{*]").match(text, end):
                    return kind
                if word == "type" and self.last in ("I{", ",") and re.compile(r"\s*(?!as\s*[,}]|as\s+\w+\s*[,}])[\w$]").match(text, end):
                    return kind
                if word == "declare" and _WORD_NEXT.match(text, end):
                    return kind
                if word == "module" and re.compile(_GAP + r"[\w$\"']").match(text, end):
                    return kind
                if word == "enum":
                    return kind
            kind = _TYPE_WORDS.get(word)
            if kind and can(kind) and re.compile(r"\s*(?!extends\b|is\b|as\b)[\w$\"'(\[{`]").match(text, end):
                return kind
        return "NAME"

    def mark(self, mark: str, at: int, end: int, line: bool) -> str:
        """Marks that TypeScript gives more meanings."""
        text, can = self.text, self.can
        if mark == "<":
            if can("TA<"):
                if not can("OP"):
                    return "TA<"
                stop = _angle_end(text, at)
                if stop > 0 and _AFTER_ANGLE.match(text, stop):
                    return "TA<"
            return "OP"
        if mark == ">":
            return "TA>" if can("TA>") else "OP"
        if mark in "&|":
            return mark if can(mark) else "OP"
        if mark == "(":
            if can("F("):
                close = closing(text, at)
                if close > 0 and _ARROW.match(text, close):
                    return "F("
            return mark
        if mark == "?":
            if can("OPT") and (not can("?") or _OPT_NEXT.match(text, end)):
                return "OPT"
            return mark
        if mark == "!":
            return "NN" if not line and can("NN") else mark
        if mark == ":":
            if self.last == ")" and can("R:") and _result_type(text, at):
                return "R:"
            return "T:" if can("T:") else mark
        return mark


def first_error(table: Table, text: str, typescript: bool) -> int:
    """Place of the first token that can't stand where it does (len(text): it ends too soon), or -1."""
    return Reader(table, text, typescript).first_error()
