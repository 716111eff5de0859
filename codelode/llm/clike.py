"""Lexers of Go, Java and C for syntax.py: tokens first, then their brackets are matched and told apart."""

from __future__ import annotations

import re

from codelode.llm.lexers import LexError, Tokens

_ESC = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8})"
_EXP = r"(?:[eE][+-]?[\d_]+)?"
_GO = re.compile(
    r"(?P<s>[ \t\r]+|//[^\n]*)|(?P<nl>\n)|(?P<c>/\*.*?\*/)"
    rf"|(?P<STRING>\"(?:{_ESC}|[^\"\\\n])*\"|`[^`]*`)|(?P<CHAR>'(?:{_ESC}|[^'\\\n])')"
    rf"|(?P<NUMBER>(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*){_EXP})i?(?![\w]))|(?P<n>[^\W\d]\w*)"
    r"|(?P<INC>\+\+|--)|(?P<ASSIGN>&\^=|<<=|>>=|[-+*/%&|^]=)|(?P<ARROW><-)|(?P<OP>&\^|<<|>>|&&|\|\||==|!=|<=|>=|[/%<>])|(?P<o>\.\.\.|:=|[-+*&|^!~=(){}\[\],;:.])",
    re.S,
)
_GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_ENDS = frozenset("NAME STRING CHAR NUMBER INC ) ] } break continue fallthrough return".split())
_GO_PARAMS = re.compile(r"\[\s*\w+\s*(?:,|\s(?:[^\W\d]|[~\[(])|\s\*\s*[\w.]+\s*[,|])")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def lex_go(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    # frames: closing mark, kind of its opener, whether the head of if, for or switch is open, whether that of a func is
    stack: list[list] = [["", "B{", False, False]]
    at, n = int(text.startswith("\ufeff")), len(text)

    def emit(kind: str) -> None:
        kinds.append(kind)
        places.append(at)

    while at < n:
        m = _GO.match(text, at)
        if not m:
            raise LexError(at)
        kind, top = m.lastgroup, stack[-1]
        last = kinds[-1] if kinds else ";"
        if kind == "nl" or (kind == "c" and "\n" in m.group()):
            if last in _GO_ENDS:
                emit(";")
                top[3] = False
        elif kind == "n":
            word = m.group()
            if word in _GO_WORDS:
                if word in ("if", "for", "switch", "select"):
                    top[2] = True
                elif word == "func" and last != "]":
                    top[3] = True
                emit(word)
            else:
                emit("NAME")
        elif kind == "o":
            mark = m.group()
            if mark == "{":
                if last == "struct":
                    mark = "S{"
                elif last == "interface":
                    mark = "I{"
                elif top[3]:
                    mark, top[3] = "B{", False
                elif top[2] and not (last == "]" or _typed(kinds)):
                    mark, top[2] = "B{", False
                elif top[1] == "B{" and last in (";", "B{", ":", "L:", "else"):
                    mark = "B{"
                else:
                    mark = "L{"
                emit(mark)
                stack.append(["}", mark, False, False])
            elif mark in "([":
                if mark == "[" and last == "NAME" and (kinds[-2:-1] == ["func"] or _method(kinds)):
                    mark = "P["
                elif mark == "[" and last == "NAME" and (kinds[-2:-1] == ["type"] or (kinds[-2:-1] in (["("], [";"]) and len(stack) > 1 and stack[-1][1] == "T(")) and _GO_PARAMS.match(text, at):
                    mark = "P["
                emit(mark)
                stack.append([_PAIRS[mark[-1]], "T(" if last == "type" else mark, False, False])
            elif mark in (")", "]", "}"):
                if len(stack) == 1 or top[0] != mark:
                    raise LexError(at)
                stack.pop()
                if mark == ")" and last == ",":
                    pass
                emit(mark)
            elif mark == ":" and last == "NAME" and top[1] == "B{" and not top[2] and (kinds[-2:-1] or [";"])[0] in (";", "B{", "L:", ":"):
                emit("L:")
            else:
                if mark in (";", ",", "=", ":="):
                    top[3] = False
                emit(mark)
        elif kind not in ("s", "c"):
            emit("ARROW" if kind == "ARROW" else kind)
        at = m.end()
    if len(stack) > 1:
        raise LexError(n)
    if kinds and kinds[-1] in _GO_ENDS:
        emit(";")
    return kinds, places


def _typed(kinds: list[str]) -> bool:
    """Whether a type of brackets, as []T or map[K]pkg.T, or a struct ends here."""
    if kinds[-1] == "}":
        depth = 0
        for i in range(len(kinds) - 1, -1, -1):
            depth += (kinds[i] == "}") - (kinds[i][-1] == "{")
            if not depth:
                return kinds[i] in ("S{", "I{")
    i = len(kinds) - 1
    while i > 1 and kinds[i] == "NAME" and kinds[i - 1] == "." and kinds[i - 2] == "NAME":
        i -= 2
    if i < 1 or kinds[i] != "NAME":
        return False
    i -= 1
    while i > 0 and kinds[i] == "*":
        i -= 1
    return kinds[i] == "]"


def _method(kinds: list[str]) -> bool:
    """Whether the name after a receiver stands here."""
    if kinds[-2:-1] != [")"]:
        return False
    depth = 0
    for i in range(len(kinds) - 2, 0, -1):
        depth += (kinds[i] == ")") - (kinds[i] == "(")
        if not depth:
            return kinds[i - 1] == "func"
    return False


def _match(kinds: list[str], places: list[int], end: int) -> list[int]:
    """For each bracket the index of the other one."""
    other, stack = [-1] * len(kinds), []
    for i, k in enumerate(kinds):
        if k in _PAIRS:
            stack.append(i)
        elif k in (")", "]", "}"):
            if not stack or _PAIRS[kinds[stack[-1]]] != k:
                raise LexError(places[i])
            other[i] = stack.pop()
            other[other[i]] = i
    if stack:
        raise LexError(end)
    return other


# ---------------------------------------------------------------- Java

_JAVA = re.compile(
    r"(?P<s>\s+|//[^\n\r]*|/\*.*?\*/)|(?P<LITERAL>\"\"\"[ \t\f]*\r?\n(?:\\.|[^\\])*?\"\"\"|\"(?!\"\"[ \t\f]*\r?\n)(?:\\(?:[btnfrs\"'\\]|u+[\da-fA-F]{4}|[0-7]{1,3})|[^\"\\\r\n])*\"|'(?:\\(?:[btnfrs\"'\\]|u+[\da-fA-F]{4}|[0-7]{1,3})|[^'\\\r\n]{1,2})'"
    rf"|(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*){_EXP})[lLfFdD]?(?![\w$]))"
    r"|(?P<n>(?:[^\W\d]|\$)[\w$]*)|(?P<ASSIGN>>>>=|<<=|>>=|[-+*/%&|^]=)|(?P<OP><=|>=|==|!=|&&|\|\||<<|[/%&|^])|(?P<o>\.\.\.|->|::|\+\+|--|[-+*!~=(){}\[\],;:.?@<>])",
    re.S,
)
_JAVA_WORDS = frozenset("package import class interface enum extends implements throws if else while do for return break continue throw try catch finally switch case default this super new instanceof assert synchronized const goto _".split())
_JAVA_PRIMS = frozenset("int long short byte char boolean float double void".split())
_JAVA_MODS = frozenset("public private protected static final abstract native transient volatile strictfp".split())
_IN_TARGS = frozenset("NAME PRIM , . ? < > [ ] @ extends super".split())


def lex_java(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    words: list[str] = []
    at, n = int(text.startswith("\ufeff")), len(text)
    if text.endswith("\x1a"):
        n -= 1
    while at < n:
        m = _JAVA.match(text, at)
        if not m:
            raise LexError(at)
        kind, word = m.lastgroup, m.group()
        if kind != "s":
            if kind == "n":
                kind = "LITERAL" if word in ("true", "false", "null") else "PRIM" if word in _JAVA_PRIMS else "MOD" if word in _JAVA_MODS else word if word in _JAVA_WORDS else "NAME"
            kinds.append(word if kind == "o" else kind)
            places.append(at)
            words.append(word)
        at = m.end()
    kinds, places, words = _java_types(kinds, places, words)
    other = _match(kinds, places, len(text))
    _java_words(kinds, words, other)
    _java_brackets(kinds, words, other)
    return kinds, places


def _java_types(kinds: list[str], places: list[int], words: list[str]) -> tuple[list[str], list[int], list[str]]:
    """Type arguments, empty brackets and operators of > become one token each."""
    out, where, said = [], [], []
    i, n = 0, len(kinds)
    while i < n:
        k, j, name = kinds[i], i + 1, kinds[i]
        if k == "<":
            stop = _java_targs(kinds, words, i)
            if stop > 0:
                j, name = stop, "TARGS"
            else:
                name = "OP"
        elif k == ">":
            while j < n and kinds[j] == ">" and places[j] == places[j - 1] + 1:
                j += 1
            name = "OP"
            if j < n and words[j] in (">=",) and places[j] == places[j - 1] + 1:
                name, j = "ASSIGN", j + 1
        elif k == "[" and kinds[i + 1 : i + 2] == ["]"]:
            j, name = i + 2, "[]"
        elif k == "@" and kinds[i + 1 : i + 2] == ["interface"]:
            j, name = i + 2, "AT_INTERFACE"
        elif words[i] == "non" and words[i + 1 : i + 3] == ["-", "sealed"]:
            j, name = i + 3, "MOD"
        out.append(name)
        where.append(places[i])
        said.append(words[i])
        i = j
    return out, where, said


def _java_targs(kinds: list[str], words: list[str], i: int) -> int:
    """The index after type arguments that begin at this <, or -1."""
    last = kinds[i - 1] if i else ";"
    if last not in ("NAME", ".", "::", "MOD", "new", ";", "{", "}", ")"):
        return -1
    depth, j, n = 0, i, len(kinds)
    while j < n:
        k = kinds[j]
        if k == "<":
            depth += 1
        elif k == ">":
            depth -= 1
            if not depth:
                break
        elif k not in _IN_TARGS and words[j] != "&":
            return -1
        elif k == "NAME" and kinds[j - 1] in ("NAME", "PRIM", "]"):
            return -1
        j += 1
    else:
        return -1
    after = kinds[j + 1] if j + 1 < n else ";"
    if last != "NAME":
        return j + 1
    if after == "NAME" and not words[i - 1][:1].isupper() and kinds[i - 2] in ("(", ",", "OP", "return", "="):
        return -1
    return j + 1 if after in ("NAME", "(", ")", "[", "::", ".", "{", ",", ";", "...", "extends", "implements", ">", "@", "=", "PRIM", "?") or words[j + 1] in ("&", "permits") else -1


def _java_words(kinds: list[str], words: list[str], other: list[int]) -> None:
    """Words of the language only where their statement or declaration stands."""
    n = len(kinds)
    for i, k in enumerate(kinds):
        after, last = kinds[i + 1] if i + 1 < n else ";", kinds[i - 1] if i else ";"
        if k == "default" and last != "case" and after not in (":", "->", "L:") and last in (";", "{", "}", "MOD", ")", "NAME") and not (last == ")" and kinds[max(0, other[i - 1] - 1)] == "NAME" and kinds[max(0, other[i - 1] - 2)] != "@" and after not in ("PRIM", "TARGS", "MOD")):
            kinds[i] = "MOD"
        elif k == "synchronized" and after != "(":
            kinds[i] = "MOD"
        elif k == "NAME":
            word = words[i]
            if word == "sealed" and after in ("MOD", "class", "interface", "NAME") and words[i + 1] != "=" and (after != "NAME" or words[i + 1] in ("abstract",)):
                kinds[i] = "MOD"
            elif word == "record" and after == "NAME" and i + 2 < n and (kinds[i + 2] == "(" or kinds[i + 2 : i + 4] == ["TARGS", "("]) and last in (";", "{", "}", "MOD", ")", "NAME", "]"):
                kinds[i] = "record"
            elif word == "permits" and last in ("NAME", "TARGS") and after == "NAME":
                kinds[i] = "permits"
            elif word == "yield" and last in (";", "{", "}", ":", "->", ")", "else") and after not in ("=", ".", "[", "++", "--", "ASSIGN", "(", "::"):
                kinds[i] = "yield"
            elif word == "when" and last in ("NAME", ")") and after not in (",", "->", ":", ")", ";", ".", "=", "(") or (word == "when" and last in ("NAME", ")") and after == "("):
                j = i - 1
                while j >= 0 and kinds[j] not in (";", "{", "}", "case"):
                    j = other[j] - 1 if kinds[j] in (")", "]") else j - 1
                if j >= 0 and kinds[j] == "case":
                    kinds[i] = "when"
            elif after == ":" and last in (";", "{", "}", "L:", ")", "else", "do", "->", ":") and (last != ")" or kinds[max(0, other[i - 1] - 1)] in ("if", "while", "for")) and (last != ":" or _after_case(kinds, i - 1)):
                kinds[i + 1] = "L:"


def _after_case(kinds: list[str], i: int) -> bool:
    """Whether the colon at i ends a case."""
    for j in range(i - 1, -1, -1):
        if kinds[j] in ("case", "default"):
            return True
        if kinds[j] in (";", "{", "}", "B{", "?"):
            return False
    return False


def _java_brackets(kinds: list[str], words: list[str], other: list[int]) -> None:
    n = len(kinds)
    head = {0: ""}  # by depth: what the next brace is
    braces: list[str] = []
    frames: list[int] = []
    pending: list[str] = [""]
    for i in range(n):
        k, last = kinds[i], kinds[i - 1] if i else ";"
        if k in ("class", "interface", "enum", "record", "AT_INTERFACE") and last != ".":
            pending[-1] = "E{" if k == "enum" else "C{"
        elif k == ";":
            pending[-1] = ""
            if braces and braces[-1] == "E{":
                braces[-1] = "C{"
        elif k in ("(", "["):
            pending.append("")
            braces.append(k)
            if k == "(":
                close = other[i]
                after = kinds[close + 1] if close + 1 < n else ";"
                if after == "->" and not _case_label(kinds, i, other):
                    kinds[i] = "A("
                elif last not in ("NAME", "TARGS", "if", "while", "for", "switch", "catch", "synchronized", "this", "super", "record", "try", ")", "]") and _cast(kinds, i, close, after):
                    kinds[i] = "K("
        elif k == "{":
            top = braces[-1] if braces else ""
            if pending[-1]:
                kind, pending[-1] = pending[-1], ""
            elif last in ("[]", "=", "L{", "(", "default") or top == "L{" or (last == "," and top == "L{"):
                kind = "L{"
            elif last == ")" and kinds[other[i - 1] - 1] == "switch":
                kind = "W{"
            elif top == "E{" and last in ("NAME", ")"):
                kind = "C{"
            elif last == ")" and _created(kinds, other[i - 1]):
                kind = "C{"
            else:
                kind = "B{"
            kinds[i] = kind
            braces.append(kind)
            pending.append("")
        elif k in (")", "]", "}"):
            braces.pop()
            pending.pop()


def _case_label(kinds: list[str], i: int, other: list[int]) -> bool:
    """Whether a record pattern or parenthesised constant of a case opens here."""
    j = i - 1
    while j >= 0 and kinds[j] in ("NAME", ".", "TARGS", ","):
        j -= 1
    return j >= 0 and kinds[j] == "case"


def _cast(kinds: list[str], i: int, close: int, after: str) -> bool:
    inner = kinds[i + 1 : close]
    if inner and inner[0] == "PRIM" and all(x == "[]" for x in inner[1:]):
        return after not in (".", "::", ";", ")", ",")
    if not inner or inner[0] != "NAME" or not all(x in ("NAME", ".", "TARGS", "[]", "OP", "PRIM") for x in inner):
        return False
    if any(a == b == "NAME" for a, b in zip(inner, inner[1:])):
        return False
    if "OP" in inner and after not in ("NAME", "A(", "("):
        return False
    if "OP" in inner and after == "NAME" or "OP" not in inner:
        return after in ("NAME", "LITERAL", "(", "!", "~", "this", "super", "new", "switch", "PRIM", "K(", "A(")
    return after == "("


def _created(kinds: list[str], i: int) -> bool:
    """Whether the arguments that open here are those of new."""
    j = i - 1
    while j >= 0 and kinds[j] in ("NAME", ".", "TARGS"):
        if kinds[j] == "NAME" and kinds[j - 1] == "NAME":
            return False
        j -= 1
    return j >= 0 and kinds[j] == "new"


# ---------------------------------------------------------------- C

_C = re.compile(
    r"(?P<s>\s+|\\\r?\n|//(?:\\\r?\n|[^\n])*|/\*.*?\*/)|(?P<STRING>(?:u8|[uUL])?\"(?:\\(?:\r\n|.)|[^\"\\\r\n])*\")|(?P<CHAR>(?:u8|[uUL])?'(?:\\.|[^'\\\r\n])+')"
    r"|(?P<NUMBER>\.?\d(?:[eEpP][+-]|'(?=\w)|[\w.])*)|(?P<n>(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<ASSIGN><<=|>>=|[-+*/%&|^]=)|(?P<OP><<|>>|<=|>=|==|!=|\|\||[/%<>|^])|(?P<o>\.\.\.|->|\+\+|--|&&|\[\[|[-+*&!~=(){}\[\],;:.?])",
    re.S,
)
_C_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:\\\r?\n|/\*.*?\*/|[^\n])*)", re.M | re.S)
_C_WORDS = frozenset("if else while do for switch case default goto return break continue struct union enum sizeof typeof _Generic".split())
_C_QUALS = frozenset("const volatile static extern register inline typedef restrict _Noreturn _Thread_local thread_local constexpr __inline __inline__ __restrict __restrict__ __const __volatile__ __extension__ _Atomic".split())
_C_TYPES = frozenset("void char short int long float double signed unsigned _Bool bool _Complex auto __int128 __signed__".split())
_C_SAME = {"__typeof__": "typeof", "typeof_unqual": "typeof", "_Alignof": "sizeof", "alignof": "sizeof", "__alignof__": "sizeof"}


def _first_branches(text: str) -> str:
    """The text with directives, and all but the first taken branch of each #if, blanked; comments and strings keep theirs."""
    spans, out, at = [(m.start(), m.end()) for m in re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S).finditer(text)], [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    k, live = 0, [[True, True]]  # taken now, some branch was taken
    for m in _C_DIRECTIVE.finditer(text):
        hash_at = text.index("#", m.start())
        while k < len(spans) and spans[k][1] <= hash_at:
            k += 1
        if (k < len(spans) and spans[k][0] < hash_at) or m.start() < at:
            continue
        piece = text[at : m.start()]
        out += [piece if all(x for x, _ in live) else blank(piece), blank(m.group())]
        at = m.end()
        word, rest = m.group(1), m.group(2).strip()
        if word in ("if", "ifdef", "ifndef"):
            no = word == "if" and re.match(r"0\s*(?:$|/)", rest)
            live.append([not no, not no])
        elif word in ("elif", "else", "elifdef", "elifndef", "endif"):
            if len(live) == 1:
                raise LexError(hash_at)
            if word == "endif":
                live.pop()
            else:
                live[-1] = [not live[-1][1], True]
    if len(live) > 1:
        raise LexError(len(text))
    return "".join(out) + text[at:]


def lex_c(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    words: list[str] = []
    source = _first_branches(text)
    at, n = int(text.startswith("\ufeff")), len(source)
    while at < n:
        m = _C.match(source, at)
        if not m:
            raise LexError(at)
        kind, word = m.lastgroup, m.group()
        at, start = m.end(), at
        if kind == "s":
            continue
        if kind == "n":
            word = _C_SAME.get(word, word)
            if word in ("__attribute__", "__declspec", "_Alignas", "alignas", "asm", "__asm__", "__asm", "_Static_assert", "static_assert"):
                at = _c_skip(source, at)
                if word.endswith("tatic_assert"):
                    kinds.append("STATIC_ASSERT")
                    places.append(start)
                    words.append(word)
                    semi = re.compile(r"\s*;").match(source, at)
                    if not semi:
                        raise LexError(at)
                    at = semi.end()
                continue
            kind = word if word in _C_WORDS else "TY" if word in _C_QUALS or word in _C_TYPES else "NAME"
            # names of macros between the parts of a string are parts of it
            if kind == "NAME" and word.isupper() | word.startswith("PRI") and kinds and kinds[-1] == "STRING":
                kind = "STRING"
            elif kind == "NAME" and (word.isupper() or word.startswith("PRI")) and re.compile(r"\s*\"").match(source, at):
                kind = "STRING"
        elif kind == "o" and word == "[[":
            end = source.find("]]", at)
            if re.compile(r"\s*[\w:]+\s*(?:\(|,|\]\])").match(source, at) and end > 0 and (not kinds or kinds[-1] in (";", "{", "}", "TY", ")")):
                at = end + 2
                continue
            kind, word, at = "o", "[", start + 1
        kinds.append(word if kind == "o" else kind)
        places.append(start)
        words.append(word)
    other = _match(kinds, places, len(text))
    _c_kinds(kinds, words, other)
    return kinds, places


def _c_skip(text: str, at: int) -> int:
    """The place after the bracketed part that follows."""
    depth = 0
    for m in re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[()]|[;{}]", re.S).finditer(text, at):
        depth += (m.group() == "(") - (m.group() == ")")
        if not depth:
            return m.end() if m.group() == ")" else m.start()
    raise LexError(len(text))


def _c_kinds(kinds: list[str], words: list[str], other: list[int]) -> None:
    n, raw = len(kinds), list(kinds)
    braces: list[str] = []
    for i in range(n):
        k, last, after = raw[i], kinds[i - 1] if i else ";", raw[i + 1] if i + 1 < n else ";"
        if k == "NAME" and last not in (".", "->", "struct", "union", "enum", "goto", "*"):
            j = i + 1
            while j < n and (raw[j] == "*" or words[j] in _C_QUALS):
                j += 1
            stars = "*" in raw[i + 1 : j]
            q = i - 1
            while q >= 0 and words[q] in _C_QUALS:
                q -= 1
            qualified = q < i - 1 and (q < 0 or raw[q] not in ("*", "NAME", ")", "]") and words[q] not in _C_TYPES or raw[q] == ")" and not _declares(raw, other, q))
            scope = not braces or braces[-1] in ("S{", "B{", "(")
            if scope and (after == "NAME" and last not in ("NAME", "TYPE") or (stars and j < n and raw[j] in (")", ",") and last in ("(", ",", "TY")) or (qualified and (stars or after in (")", ",", "(", "NAME") and not (after == "(" and raw[i + 2 : i + 3] != ["*"]))) or (j > i + 1 and not stars)):
                kinds[i] = "TYPE"
            elif braces and braces[-1] == "B{" and last in (";", "}", "B{") and (
                (after == "(" and raw[i + 2 : i + 6] == ["*", "NAME", ")", "("]) or (stars and raw[j : j + 2] == ["NAME", "("] and raw[j + 2 : j + 3] and raw[j + 2] in ("TY", "struct", "union", "enum"))
            ):
                kinds[i] = "TYPE"  # a pointer to a function, or a prototype, in a block
            elif after == "(" and last in (";", "}", "{", "B{", "L:", "M)") or (after == "(" and i and last == ")" and not braces):
                close = other[i + 1]
                follow = raw[close + 1] if close + 1 < n else ";"
                if not braces and follow not in ("{", "(", "[", ",", "=") and not (follow in ("NAME", "TY") and _old_style(raw, close)):
                    kinds[i] = "M"
                elif braces and braces[-1] == "B{" and follow == "{":
                    kinds[i] = "M"
            elif after == ":" and braces and braces[-1] == "B{" and last in (";", "}", "B{", "L:", ":", ")", "else") and (last != ")" or raw[other[i - 1] - 1] in ("if", "while", "for", "switch")) and (last != ":" or _after_case(kinds, i - 1)):
                kinds[i + 1] = raw[i + 1] = "L:"
        elif k == "{":
            b = i - 1
            while b >= 0 and raw[b] == "NAME" and raw[b - 1] in ("struct", "union", "enum"):
                b -= 1
            if b >= 0 and raw[b] in ("struct", "union"):
                kind = "S{"
            elif b >= 0 and raw[b] == "enum":
                kind = "E{"
            elif last == "=" or (braces and braces[-1] == "L{") or (last == ")" and kinds[other[i - 1]] == "K("):
                kind = "L{"
            else:
                kind = "B{"
            kinds[i] = kind
            braces.append(kind)
            continue
        elif k in ("(", "["):
            braces.append("(" if k == "(" else "[")
            if k == "(" and last not in ("NAME", "M", "typeof", "TYPE", "TY", "]", "if", "while", "for", "switch", "_Generic") and not (last == ")" and kinds[other[i - 1]] != "K("):
                close = other[i]
                inner, follow = raw[i + 1 : close], raw[close + 1] if close + 1 < n else ";"
                if inner == ["NAME"] and (follow in ("NAME", "NUMBER", "STRING", "CHAR", "!", "~", "{", "sizeof")) and last != "sizeof":
                    kinds[i] = "K("
                elif inner and (inner[0] in ("TY", "struct", "union", "enum", "typeof") or (inner[0] == "NAME" and "*" in inner and all(x == "*" or words[i + 2 + p] in _C_QUALS for p, x in enumerate(inner[1:])))):
                    kinds[i] = "K("
        elif k in (")", "]", "}"):
            braces.pop()
    # a name alone in a cast is a type
    for i in range(n - 2):
        if kinds[i] == "K(" and kinds[i + 1] == "NAME":
            kinds[i + 1] = "TYPE"


def _declares(raw: list[str], other: list[int], close: int) -> bool:
    return raw[other[close] - 1] == "NAME"


def _old_style(raw: list[str], close: int) -> bool:
    """Whether declarations of parameters and then a body follow."""
    for k in raw[close + 1 :]:
        if k == "{":
            return True
        if k in ("(", ")", "}", "="):
            return False
    return False
