"""Problem 10: text statistics per document, and texts that are not prose.

Layout comes first. Delimiters that stand under each other, by column or by their number in lines
that follow each other, make tables; first tokens of one shape, and steps of indentation that come
again, make lists; lengths of lines that repeat with a period make output and records. A line of
such a layout is prose only if it reads as a sentence by itself. The other lines are joined to
stretches, and a stretch is prose if common words of a language make up enough of it, less its
tokens of symbols, and its words aren't the same again and again. A text is prose if most of its
characters are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codelode.plans.sizing import spread

#: Common words by language, chosen for this module.
COMMON = {
    "en": "the of and to in a is it that for on was with as be by this are not have has had but at from they which or an we you he its there been were will would can may if than then them what when where who how all no do does did so about into after before because both only other one two up out any each most now yet i my us me until while".split(),
    "de": "der die das und ist ein eine einen einem einer nicht es zu den dem des mit auf für von im in an als auch sich noch aber wird wurde sind hat haben er sie wir ich du dass wenn weil was wie nur nach vor aus bei zum zur über unter mehr hier oder kann bitte warum beim dieser diese dieses mehr wo".split(),
    "fr": "le la les l d n c qu s un une des du de et est pas ne que qui dans sur au aux ce cette ces il elle nous vous je ils se sa son ses par pour avec plus mais ou où si encore été être avait ont sont a à en y on cela fois deux avant parce tout sans".split(),
    "es": "el la los las un una unos de del al en que es no se por con para su sus lo le ha han hay pero como más este esta si cuando porque donde sin sobre antes dos todavía también fue era ser está y o ya aún solo".split(),
}
PROSE_SHARE = 0.5  # of the characters of a text
COMMON_SHARE = 0.28  # of the tokens of a stretch, less half of its share of symbol tokens
SYMBOL_SHARE = 0.5  # of the tokens of a line that is code or output
SENTENCE_TOKENS = 7  # a line within a list or table is a sentence from so many tokens on
PERIODS = (1, 2, 3, 4)  # lags of the autocorrelation of line lengths
CORRELATED = 0.6
MARKS_HELD = 100_000  # tokens whose marks a process remembers
REPEATED_WINDOW, REPEATED_SHARE = 100, 0.2  # words; distinct pairs of words in a window of prose
COLUMNS = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "table_lines", "list_lines", "repeated_lines", "line_autocorrelation", "indent_period", "prose_share")

_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_SYMBOL = re.compile(r"[=(){}\[\]<>|\\;_*+^~$#@&%`\"]|^\W+$|^\d[\d.,:%-]*$")
_END = tuple(".!?:;…。")
_DELIMITERS = {"|": re.compile(r"\|"), "tab": re.compile(r"\t"), ";": re.compile(";"), ",": re.compile(","), ":": re.compile(r":(?=\s|$)"), "=": re.compile("="), "gap": re.compile(r"(?<=\S) {2,}(?=\S)"), "dots": re.compile(r"\.{3,}")}
#: What a line begins with, by shape: marks of items, numbers of items, words before a mark.
_FIRST = re.compile(r"\s*(?:(?P<mark>[^\w\s\"'(¿¡`«„“]{1,3})\s+(?=\S)|(?P<number>\(?(?:\d{1,4}|[a-zA-Z])[.)])\s+(?=\S)|(?P<key>[\w./-]+)\s*(?:[:=]|\.{3,}|->)(?=\s))")


def aligned_lines(lines: list[str]) -> list[bool]:
    """Lines whose delimiters stand in columns of a line beside them, or divide it in as many short cells."""
    found = [False] * len(lines)
    words = [len(x.split()) for x in lines]
    whole = "\n".join(lines)
    for rx in _DELIMITERS.values():
        if not rx.search(whole):
            continue
        spots = [[m.start() for m in rx.finditer(x)] for x in lines]
        for i in range(len(lines) - 1):
            a, b = spots[i], spots[i + 1]
            if not a or not b:
                continue
            together = len(set(a) & set(b))
            for k in (i, i + 1):
                n = len(spots[k])
                # cells are short: prose has many words for each of its marks
                if found[k] or words[k] > 3 * (n + 1):
                    continue
                if (together * 2 > n and words[k] <= 2 * (n + 1)) or (n >= 2 and abs(len(a) - len(b)) <= 1) or (n == 1 and len(a) == len(b) and words[k] <= 4):
                    found[k] = True
    return found


def first_shapes(lines: list[str]) -> list[str | None]:
    """The shape of what each line begins with, where the line beside it, or the one after that, begins alike."""
    shapes = [(m.lastgroup + (m.group("mark") or "")) if (m := _FIRST.match(x)) else None for x in lines]
    n = len(shapes)
    return [s if s and any(0 <= j < n and shapes[j] and shapes[j][:4] == s[:4] for j in (i - 2, i - 1, i + 1, i + 2)) else None for i, s in enumerate(shapes)]


def indent_period(lines: list[str]) -> tuple[int, list[bool]]:
    """(the step of indentation, 0 for none; the lines whose indentation is a multiple of it, beside other multiples)."""
    depth = [len(x) - len(x.lstrip()) for x in lines]
    changes = Counter(abs(b - a) for a, b in zip(depth, depth[1:]) if a != b)
    step = min((d for d, n in changes.items() if n >= 2), default=0) if sum(changes.values()) >= 2 else 0
    if not step:
        return 0, [False] * len(lines)
    n = len(depth)
    return step, [d % step == 0 and any(0 <= j < n and depth[j] != d and (depth[j] - d) % step == 0 for j in (i - 2, i - 1, i + 1, i + 2)) for i, d in enumerate(depth)]


def autocorrelation(lengths: list[int]) -> float:
    """The largest one of the lengths of lines over PERIODS; 1 if all are equal, 0 for fewer than 6 lines."""
    n = len(lengths)
    if n < 6:
        return 0.0
    mean = sum(lengths) / n
    off = [x - mean for x in lengths]
    spread = sum(x * x for x in off)
    if not spread:
        return 1.0
    return max(sum(a * b for a, b in zip(off, off[k:])) / spread * n / (n - k) for k in PERIODS)


class Profiler:
    """Statistics of one text after the other; common words of all languages count alike, as texts may name a wrong one."""

    def __init__(self, common: dict[str, list[str]] = COMMON) -> None:
        self.common = frozenset(w for words in common.values() for w in words)
        self._marks: dict[str, int] = {}

    def _mark(self, token: str) -> int:
        """1 for a token with a common word, 2 for one of symbols, 3 for both; most tokens come again and again."""
        mark = 2 if _SYMBOL.search(token) else 0
        if len(token) <= 40:  # a word with its apostrophes and marks, no longer run of characters
            parts = _WORD.findall(token.lower())
            if len(parts) <= 3 and any(w in self.common for w in parts):
                mark |= 1
        if len(self._marks) >= MARKS_HELD:
            self._marks.clear()
        self._marks[token] = mark
        return mark

    def _counts(self, line: str) -> tuple[int, int, int]:
        """(tokens, common words, tokens of symbols)."""
        known, tokens = self._marks, line.split()
        marks = [known[t] if t in known else self._mark(t) for t in tokens]
        both = marks.count(3)
        return len(tokens), marks.count(1) + both, marks.count(2) + both

    @staticmethod
    def _share(counts: tuple[int, int, int]) -> float:
        n, hits, symbols = counts
        return (hits - 0.5 * symbols) / n if n else 0.0

    @staticmethod
    def _varied(lines: list[str]) -> bool:
        """Whether words come in ever new pairs, in most windows of a fixed number of words, and have letters."""
        words = _WORD.findall("\n".join(lines).lower())
        if len(words) < 3 or sum(map(len, words)) < 2 * len(words):
            return False
        dull = windows = 0
        for lo in range(0, len(words), REPEATED_WINDOW):
            part = words[lo : lo + REPEATED_WINDOW]
            if len(part) >= 12:
                windows += 1
                dull += len(set(zip(part, part[1:]))) < REPEATED_SHARE * len(part)
        return dull * 2 <= windows

    def profile(self, text: str) -> tuple:
        lines = [x for x in text.splitlines() if x.strip()]
        n = len(lines)
        words = _WORD.findall(text.lower())
        letters = sum(map(len, words))
        dense = sum(map(len, text.split()))
        digits = sum(map(len, _DIGITS.findall(text)))
        counts = [self._counts(x) for x in lines]
        tables = aligned_lines(lines)
        firsts = first_shapes(lines)
        step, stepped = indent_period(lines)
        lengths = [len(x) for x in lines]
        periodic = autocorrelation(lengths) >= CORRELATED
        seen = Counter(x.strip() for x in lines)
        prose, repeated, listed = 0, 0, 0
        stretch: list[int] = []
        for i in range(n + 1):
            if i < n:
                tokens, _, symbols = counts[i]
                own = self._share(counts[i])
                again = seen[lines[i].strip()] > 2
                repeated += again
                in_list = firsts[i] is not None or (stepped[i] and own < COMMON_SHARE)
                listed += in_list
                structured = tables[i] or again or in_list or (symbols >= SYMBOL_SHARE * tokens and own < COMMON_SHARE) or (periodic and own < COMMON_SHARE / 2)
                if not structured:
                    stretch.append(i)
                    continue
            if stretch:
                prose += self._prose(lines, counts, stretch)
                stretch = []
            if i < n and tokens >= SENTENCE_TOKENS and own >= COMMON_SHARE and lines[i].rstrip().endswith(_END) and not again and self._varied([lines[i]]):
                prose += lengths[i]  # a sentence of its own within a list or table
        n = n or 1
        return (
            len(words),
            letters / len(words) if words else 0.0,
            (dense - letters - digits) / dense if dense else 0.0,
            sum(x.rstrip().endswith(_END) for x in lines) / n,
            sum(map(self.common.__contains__, words)) / len(words) if words else 0.0,
            sum(tables) / n,
            listed / n,
            repeated / n,
            autocorrelation(lengths),
            step,
            prose / (sum(lengths) or 1),
        )

    def _prose(self, lines: list[str], counts: list[tuple[int, int, int]], stretch: list[int]) -> int:
        """Characters of prose in a stretch: all but lines without common words whose neighbours have few."""
        total = tuple(sum(counts[i][k] for i in stretch) for k in range(3))
        if self._share(total) < COMMON_SHARE or not self._varied([lines[i] for i in stretch]):
            return 0
        if len(stretch) == 1:
            return len(lines[stretch[0]])
        own = [self._share(counts[i]) for i in stretch]
        size = 0
        for k, i in enumerate(stretch):
            if own[k] > 0.1 or (max(own[max(0, k - 1) : k + 2]) > 0.25 and own[k] >= 0 and counts[i][0] > 4):
                size += len(lines[i])
        return size


EMPTY = tuple(0 if c in ("words", "indent_period") else 0.0 for c in COLUMNS)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    profiler = Profiler()
    for pdf in batches:
        rows = [profiler.profile(x) if x else EMPTY for x in pdf["text"]]
        out = pd.DataFrame(rows, columns=list(COLUMNS))
        out.insert(0, "doc", pdf["doc"].to_numpy())
        out["blank"] = [not x or not x.strip() for x in pdf["text"]]
        yield out


def text_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: statistics of COLUMNS, and `blank`.

    Null, empty and blank texts have 0 in all statistics and are blank. Texts of any length are read
    whole. Rows repeat as they come, null ids too. Other columns are ignored. Nothing is shuffled, but
    an input of fewer files than cores is dealt to all of them.
    """
    types = ", ".join(f"{c} {'int' if c in ('words', 'indent_period') else 'double'}" for c in COLUMNS)
    rows = spread(documents.selectExpr(f"cast(`{doc_id}` as long) as doc", f"`{text}` as text"))
    return rows.mapInPandas(_run, f"doc long, {types}, blank boolean").withColumnRenamed("doc", doc_id)


def not_prose(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = PROSE_SHARE) -> DataFrame:
    """(doc_id) of texts less than half of whose characters are prose; blank texts are none."""
    return text_statistics(documents, doc_id, text).where(f"not blank and prose_share < {share}").select(doc_id)
