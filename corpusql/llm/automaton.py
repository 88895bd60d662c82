"""Rule patterns to one minimal byte automaton: Thompson construction, subset construction, Moore minimisation.

Patterns are over bytes and know literals, \\xHH and other escapes, classes, groups, alternation and ? * + {n} {n,}.
"""

from __future__ import annotations

import numpy as np


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class _Pattern:
    """Reads a pattern into an NFA fragment; a fragment is made anew for every repetition."""

    def __init__(self, text: str, nfa: _Nfa):
        self.text, self.at, self.nfa = text, 0, nfa

    def tree(self):
        out = self._either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} of {self.text!r}")
        return out

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _either(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("either", options)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated(self._atom()))
        return ("sequence", parts)

    def _atom(self):
        c = self._peek()
        self.at += 1
        if c == "(":
            inner = self._either()
            self.at += 1
            return inner
        if c == "[":
            return ("bytes", self._class())
        return ("bytes", frozenset([self._escape() if c == "\\" else ord(c)]))

    def _escape(self) -> int:
        c = self._peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _class(self) -> frozenset[int]:
        out: set[int] = set()
        while self._peek() != "]":
            c = self._peek()
            self.at += 1
            low = self._escape() if c == "\\" else ord(c)
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                high = ord(self.text[self.at + 1])
                self.at += 2
                out.update(range(low, high + 1))
            else:
                out.add(low)
        self.at += 1
        return frozenset(out)

    def _repeated(self, atom):
        c = self._peek()
        if c and c in "?*+":
            self.at += 1
            return ("repeat", atom, 1 if c == "+" else 0, 1 if c == "?" else None)
        if c == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return ("repeat", atom, int(low), int(high) if high else None if comma else int(low))
        return atom

    def build(self, node, start: int) -> int:
        """Adds the node after ``start``; returns its last state."""
        nfa = self.nfa
        if node[0] == "bytes":
            end = nfa.state()
            nfa.moves[start].append((node[1], end))
            return end
        if node[0] == "sequence":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if node[0] == "either":
            end = nfa.state()
            for option in node[1]:
                first = nfa.state()
                nfa.empty[start].append(first)
                nfa.empty[self.build(option, first)].append(end)
            return end
        _, atom, low, high = node
        for _ in range(low):
            start = self.build(atom, start)
        if high is None:
            loop = nfa.state()
            nfa.empty[start].append(loop)
            nfa.empty[self.build(atom, loop)].append(loop)
            return loop
        ends = [start]
        for _ in range(high - low):
            start = self.build(atom, start)
            ends.append(start)
        end = nfa.state()
        for s in ends:
            nfa.empty[s].append(end)
        return end


def _reversed(node):
    """The tree of the same matches read from behind."""
    if node[0] == "sequence":
        return ("sequence", [_reversed(part) for part in reversed(node[1])])
    if node[0] == "either":
        return ("either", [_reversed(option) for option in node[1]])
    return node if node[0] == "bytes" else ("repeat", _reversed(node[1]), *node[2:])


class Automaton:
    """All rules as transition arrays.

    classes: byte to column; step: state times columns + column to state; accepts: state to a bit mask of rules.
    State 0 is the start. anywhere: a match may begin at every byte, else only at the first (state -1 is then dead).
    backward: for bytes read from behind, so accepting states tell where matches begin.
    """

    def __init__(self, patterns: list[str], anywhere: bool, backward: bool = False):
        nfa = _Nfa()
        root = nfa.state()
        final: dict[int, int] = {}
        for k, text in enumerate(patterns):
            pattern = _Pattern(text, nfa)
            first = nfa.state()
            nfa.empty[root].append(first)
            tree = pattern.tree()
            final[pattern.build(_reversed(tree) if backward else tree, first)] = 1 << k
        self.classes, kinds = self._byte_classes(nfa)
        begin = nfa.closure([root])
        states, todo, rows = {begin: 0}, [begin], []
        while todo:
            now = todo.pop(0)
            row = []
            for b in kinds:
                to = nfa.closure([t for s in now for chars, t in nfa.moves[s] if b in chars])
                to = to | begin if anywhere else to
                if not to:
                    row.append(-1)
                    continue
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                row.append(states[to])
            rows.append(row)
        accepts = np.array([sum({final[s] for s in q if s in final}) for q in states], np.int64)
        self.step, self.accepts = self._minimal(np.array(rows, np.int64), accepts)
        self.columns = len(kinds)

    def reachable(self) -> np.ndarray:
        """For each state the rules that can still accept, there or later."""
        reach = self.accepts.copy()
        while True:
            on = np.where(self.step >= 0, reach[self.step], 0)
            new = reach | np.bitwise_or.reduce(on, axis=1)
            if (new == reach).all():
                return reach
            reach = new

    @staticmethod
    def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
        """Bytes that no rule tells apart share a column; and one byte of each column."""
        sets = list({chars for moves in nfa.moves for chars, _ in moves})
        names: dict[tuple, int] = {}
        classes = np.array([names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)], np.int64)
        return classes, [int(np.flatnonzero(classes == k)[0]) for k in range(len(names))]

    @staticmethod
    def _minimal(rows: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = np.unique(accepts, return_inverse=True)[1]
        while True:
            seen = np.column_stack([part, np.where(rows >= 0, part[rows], -1)])
            new = np.unique(seen, axis=0, return_inverse=True)[1].ravel()
            if new.max() == part.max():
                break
            part = new
        order = np.argsort(np.unique(part, return_index=True)[1])  # classes by their first state, so the start is 0
        name = np.empty(len(order), np.int64)
        name[order] = np.arange(len(order))
        part = name[part]
        first = np.unique(part, return_index=True)[1]
        return np.where(rows[first] >= 0, part[rows[first]], -1), accepts[first]
