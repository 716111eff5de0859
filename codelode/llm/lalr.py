"""LALR(1) tables from grammar texts, and a recogniser that reports the first error.

A grammar is rules `name: alternative | alternative ;` over quoted terminals ('if'), terminal
classes (NAME) and rule names, with ( ), postfix ? * + and [ ] for options. The first rule is the
start. Conflicts are decided for shifting, then for the rule written first. Lookaheads follow the
method of DeRemer and Pennello.
"""

from __future__ import annotations

import re

_ITEM = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:(?P<lit>'[^']*')|(?P<name>\w+)|(?P<op>[:;|()\[\]?*+]))")
END = "$"


def read_grammar(text: str) -> tuple[list[tuple[str, tuple[str, ...]]], str]:
    """Plain productions (left side, right side); terminals are quoted or in upper case."""
    tokens, at = [], 0
    text = re.sub(r"#[^\n]*", "", text)
    while text[at:].strip():
        m = _ITEM.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        tokens.append(m.group("lit") or m.group("name") or m.group("op"))
        at = m.end()
    rules: list[tuple[str, tuple[str, ...]]] = []
    named: dict[tuple, str] = {}

    def alternatives(i: int) -> tuple[list[tuple[str, ...]], int]:
        out: list[tuple[str, ...]] = []
        current: list[tuple[str, ...]] = [()]
        while True:
            t = tokens[i]
            if t in (";", ")", "]"):
                return out + current, i
            if t == "|":
                out, current, i = out + current, [()], i + 1
                continue
            if t in ("(", "["):
                inner, i = alternatives(i + 1)
                if t == "[":
                    inner = [*inner, ()]
                i += 1
            else:
                inner, i = [(t,)], i + 1
            while i < len(tokens) and tokens[i] in ("?", "*", "+"):
                mark = tokens[i]
                i += 1
                if mark == "?":
                    inner = [*inner, ()]
                else:
                    key = tuple(sorted(set(inner)))
                    if key not in named:
                        named[key] = f"_{len(named)}"
                        for x in inner:
                            rules.append((named[key], x))
                            rules.append((named[key], (named[key], *x)))
                    inner = [(named[key],)] if mark == "+" else [(named[key],), ()]
            current = [a + b for a in current for b in dict.fromkeys(inner)]

    i, start = 0, ""
    while i < len(tokens):
        name = tokens[i]
        start = start or name
        found, i = alternatives(i + 2)
        rules += [(name, x) for x in dict.fromkeys(found)]
        i += 1
    return list(dict.fromkeys(rules)), start


class Table:
    """The automaton of a grammar; terminals are numbered by `ids`."""

    def __init__(self, text: str) -> None:
        rules, start = read_grammar(text)
        rules = [("^", (start,)), *rules]
        lefts = {a for a, _ in rules}
        for _, right in rules:
            for x in right:
                if x not in lefts and not (x[0] == "'" or x.isupper()):
                    raise ValueError(f"grammar: no rule {x}")
        names = dict.fromkeys(x for _, r in rules for x in r if x not in lefts)
        self.ids = {x.strip("'") if x[0] == "'" else x: i for i, x in enumerate(names, 1)}
        self.ids[END] = 0
        number = {x: self.ids[x.strip("'") if x[0] == "'" else x] for x in names}
        self.names = {i: n for n, i in self.ids.items()}
        self._build(rules, lefts, number)

    def _build(self, rules: list, lefts: set, number: dict) -> None:
        by_left: dict[str, list[int]] = {}
        for i, (a, _) in enumerate(rules):
            by_left.setdefault(a, []).append(i)
        nullable: set[str] = set()
        while True:
            more = {a for a, r in rules if a not in nullable and all(x in nullable for x in r)}
            if not more:
                break
            nullable |= more

        def closure(kernel: tuple) -> list[tuple[int, int]]:
            items, seen = list(kernel), set()
            for r, d in items:
                right = rules[r][1]
                if d < len(right) and right[d] in by_left and right[d] not in seen:
                    seen.add(right[d])
                    items += [(k, 0) for k in by_left[right[d]]]
            return list(dict.fromkeys(items))

        states: dict[tuple, int] = {((0, 0),): 0}
        order, moves, done = [((0, 0),)], [], []
        for kernel in order:
            items = closure(kernel)
            nexts: dict[str, list] = {}
            for r, d in items:
                if d < len(rules[r][1]):
                    nexts.setdefault(rules[r][1][d], []).append((r, d + 1))
            move = {}
            for x, k in nexts.items():
                key = tuple(sorted(k))
                if key not in states:
                    states[key] = len(order)
                    order.append(key)
                move[x] = states[key]
            moves.append(move)
            done.append([r for r, d in items if d == len(rules[r][1])])

        pairs = [(p, a) for p, move in enumerate(moves) for a in move if a in lefts]
        index = {x: i for i, x in enumerate(pairs)}
        first, reads = [], []
        for p, a in pairs:
            q = moves[p][a]
            first.append(sum(1 << number[x] for x in moves[q] if x in number) | (1 if (p, a) == (0, rules[0][1][0]) else 0))
            reads.append([index[q, x] for x in moves[q] if x in nullable])
        includes: list[list[int]] = [[] for _ in pairs]
        looks: dict[tuple[int, int], list[int]] = {}
        for i, (p, a) in enumerate(pairs):
            for r in by_left[a]:
                q, right = p, rules[r][1]
                for d, x in enumerate(right):
                    if x in lefts and all(y in nullable for y in right[d + 1 :]):
                        includes[index[q, x]].append(i)
                    q = moves[q][x]
                looks.setdefault((q, r), []).append(i)

        def spread(values: list[int], edges: list[list[int]]) -> list[int]:
            values = list(values)
            back: list[list[int]] = [[] for _ in values]
            for i, to in enumerate(edges):
                for j in to:
                    back[j].append(i)
            todo = list(range(len(values)))
            while todo:
                j = todo.pop()
                for i in back[j]:
                    if values[j] & ~values[i]:
                        values[i] |= values[j]
                        todo.append(i)
            return values

        follow = spread(spread(first, reads), includes)
        #: Per state: terminal -> state to shift to (from 1), or -(rule + 1) to reduce, 0 to accept.
        self.actions: list[dict[int, int]] = []
        self.gotos: list[dict[int, int]] = []
        heads = {a: i for i, a in enumerate(by_left)}
        self.rules = [(len(r), heads[a]) for a, r in rules]
        self.conflicts = 0
        for p, move in enumerate(moves):
            action = {number[x]: q for x, q in move.items() if x in number}
            shifts = set(action)
            for r in sorted(done[p]):
                if r == 0:
                    action[0] = 0
                    continue
                mask, t = 0, 0
                for i in looks.get((p, r), ()):
                    mask |= follow[i]
                while mask:
                    if mask & 1:
                        if t in shifts or t in action:
                            self.conflicts += 1
                        else:
                            action[t] = -r - 1
                    mask >>= 1
                    t += 1
            self.actions.append(action)
            self.gotos.append({heads[x]: q for x, q in move.items() if x in lefts})
        self.states = len(moves)
        self._units: dict[tuple[int, int, int], int] = {}

    def accepts_next(self, stack: list[int], token: int) -> bool:
        """Whether the token can be shifted, or the text accepted, after this stack, which isn't changed."""
        actions, gotos, rules = self.actions, self.gotos, self.rules
        a = actions[stack[-1]].get(token)
        if a is None:
            return False
        low, over = len(stack), []  # what is left of the stack, and what lies on it
        while a < 0:
            n, head = rules[-a - 1]
            if n <= len(over):
                if n:
                    del over[-n:]
            else:
                low -= n - len(over)
                over.clear()
            over.append(gotos[over[-1] if over else stack[low - 1]][head])
            a = actions[over[-1]].get(token)
            if a is None:
                return False
        return True

    def feed(self, stack: list[int], token: int) -> bool:
        """Shifts a token onto the stack, or says that it can't follow and leaves the stack as it is."""
        actions, gotos, rules, known = self.actions, self.gotos, self.rules, self._units
        a = actions[stack[-1]].get(token)
        if a is None:
            return False
        if a >= 0:
            if a:
                stack.append(a)
            return True
        low, over = len(stack), []  # what is left of the stack, and what lies on it
        while a < 0:
            n, head = rules[-a - 1]
            if n == 1:
                # a chain of rules with one symbol ends in the same state whenever it begins alike
                if over:
                    top = over.pop()
                else:
                    low -= 1
                    top = stack[low]
                below = over[-1] if over else stack[low - 1]
                key = (below, top, token)
                to = known.get(key)
                if to is None:
                    to = gotos[below][head]
                    while (b := actions[to].get(token)) is not None and b < 0 and rules[-b - 1][0] == 1:
                        to = gotos[below][rules[-b - 1][1]]
                    known[key] = to
                over.append(to)
            else:
                if n <= len(over):
                    if n:
                        del over[-n:]
                else:
                    low -= n - len(over)
                    over.clear()
                over.append(gotos[over[-1] if over else stack[low - 1]][head])
            a = actions[over[-1]].get(token)
            if a is None:
                return False
        del stack[low:]
        stack += over
        if a:
            stack.append(a)
        return True

    def first_error(self, tokens: list[int]) -> int:
        """Index of the first token that can't follow, len(tokens) for a premature end, -1 if all is well."""
        stack, feed = [0], self.feed
        for i, token in enumerate(tokens):
            if not feed(stack, token):
                return i
        return -1 if feed(stack, 0) else len(tokens)
