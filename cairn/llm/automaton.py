"""A deterministic automaton over characters, built from several grammars at once.

Each grammar is a pattern of literals, character classes, groups, alternatives and counts; together they are one
nondeterministic automaton, and the deterministic one is its subset construction, made state by state as texts need it
and kept.  One walk over the text follows all grammars at the same time and gives the longest match of each.
"""

from __future__ import annotations

import re

_CLASSES = {"d": "0123456789", "w": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"}
_TOKEN = re.compile(r"(?P<open>\(\?:)|(?P<close>\))|(?P<bar>\|)|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<count>\{\d+(?:,\d*)?\}|[?*+])|(?P<escape>\\.)|(?P<char>[^\\])", re.S)


def _set(body: str) -> tuple[frozenset[str], bool]:
    """The characters of a bracketed class, and whether they are excluded."""
    out: set[str] = set()
    items = re.findall(r"\\.|.", body[1:-1], re.S)
    negated = bool(items) and items[0] == "^"
    items = items[negated:]
    k = 0
    while k < len(items):
        x = items[k]
        if len(x) == 2 and x[1] in _CLASSES:
            out |= set(_CLASSES[x[1]])
        elif len(x) == 2 and x[1] == "s":
            out |= set(" \t\n\r\f\v")
        elif k + 2 < len(items) and items[k + 1] == "-":
            out |= {chr(c) for c in range(ord(x[-1]), ord(items[k + 2][-1]) + 1)}
            k += 2
        else:
            out.add(x[-1])
        k += 1
    return frozenset(out), negated


class Grammars:
    """Named patterns as one automaton.  ``longest(text, at)`` gives {name: end} of those that match from ``at``."""

    def __init__(self, patterns: dict[str, str]):
        self._moves: list[list[tuple[frozenset[str], bool, int]]] = []
        self._free: list[list[int]] = []
        self._ends: dict[int, str] = {}
        begin = self._new()
        for name, pattern in patterns.items():
            tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(pattern)]
            first, last, rest = self._choice(tokens, 0)
            if rest != len(tokens):
                raise ValueError(f"pattern {name!r} can't be read at part {rest}")
            self._free[begin].append(first)
            self._ends[last] = name
        self._states: dict[frozenset[int], int] = {}
        self._table: list[dict[str, int]] = []
        self._sets: list[frozenset[int]] = []
        self._names: list[tuple[str, ...]] = []
        self.begin = self._state(self._closed({begin}))

    # the nondeterministic automaton ------------------------------------------------------------------------------

    def _new(self) -> int:
        self._moves.append([])
        self._free.append([])
        return len(self._moves) - 1

    def _choice(self, tokens: list, k: int) -> tuple[int, int, int]:
        first, last = self._new(), self._new()
        while True:
            a, b, k = self._row(tokens, k)
            self._free[first].append(a)
            self._free[b].append(last)
            if k < len(tokens) and tokens[k][0] == "bar":
                k += 1
                continue
            return first, last, k

    def _row(self, tokens: list, k: int) -> tuple[int, int, int]:
        first = last = self._new()
        while k < len(tokens) and tokens[k][0] not in ("bar", "close"):
            start = k
            least, most = 1, 1
            after = self._skip(tokens, k)
            if after < len(tokens) and tokens[after][0] == "count":
                sign = tokens[after][1]
                lo, comma, hi = sign.strip("{}").partition(",")
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign) or (int(lo), int(hi) if hi else None if comma else int(lo))
            for _ in range(least):
                a, b, k = self._atom(tokens, start)
                self._free[last].append(a)
                last = b
            if most is None:
                a, b, k = self._atom(tokens, start)
                self._free[last].append(a)
                self._free[b].append(last)
            for _ in range((most or least) - least):
                a, b, k = self._atom(tokens, start)
                out = self._new()
                self._free[last] += [a, out]
                self._free[b].append(out)
                last = out
            k = after + (after < len(tokens) and tokens[after][0] == "count")
        return first, last, k

    def _skip(self, tokens: list, k: int) -> int:
        """The place after the atom that stands at ``k``."""
        depth = 0
        while True:
            depth += (tokens[k][0] == "open") - (tokens[k][0] == "close")
            k += 1
            if depth == 0:
                return k

    def _atom(self, tokens: list, k: int) -> tuple[int, int, int]:
        kind, body = tokens[k]
        if kind == "open":
            a, b, k = self._choice(tokens, k + 1)
            return a, b, k + 1
        a, b = self._new(), self._new()
        chars, negated = _set(body) if kind == "set" else _set(f"[{body}]") if kind == "escape" else (frozenset(body), False)
        self._moves[a].append((chars, negated, b))
        return a, b, k + 1

    # the deterministic one ---------------------------------------------------------------------------------------

    def _closed(self, states: set[int]) -> frozenset[int]:
        stack, seen = list(states), set(states)
        while stack:
            for x in self._free[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(x for x in seen if self._moves[x] or x in self._ends)

    def _state(self, states: frozenset[int]) -> int:
        if states not in self._states:
            self._states[states] = len(self._table)
            self._table.append({})
            self._sets.append(states)
            self._names.append(tuple(sorted({self._ends[x] for x in states if x in self._ends})))
        return self._states[states]

    def _step(self, state: int, char: str) -> int:
        """The next state, -1 if no grammar goes on; remembered, but for characters of no alphabet of its own."""
        to = {b for x in self._sets[state] for chars, negated, b in self._moves[x] if (char in chars) != negated}
        out = self._state(self._closed(to)) if to else -1
        if char < "Ā":
            self._table[state][char] = out
        return out

    def longest(self, text: str, at: int) -> dict[str, int]:
        """The end of the longest match from ``at`` of each grammar that matches there."""
        state, found = self.begin, {}
        table, names = self._table, self._names
        for k in range(at, len(text)):
            to = table[state].get(text[k], -2)
            if to == -2:
                to = self._step(state, text[k])
            if to < 0:
                break
            state = to
            for n in names[state]:
                found[n] = k + 1
        return found
