"""Regular expressions over bytes as minimal deterministic automata.

``compile_automaton`` turns any number of expressions into one transition
array by Thompson's construction, subset construction and partition
refinement. Supported: literals, ``\\`` escapes (``\\xHH`` too), classes with
ranges and ``^``, groups, ``|`` and the quantifiers ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ALL = (1 << 256) - 1


class _Parser:
    """Nodes: ('set', mask), ('cat', [nodes]), ('alt', [nodes]),
    ('rep', node, least, most or None)."""

    def __init__(self, text: str, any_case: bool):
        self.text, self.at, self.any_case = text, 0, any_case

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while self.peek() and self.peek() in "?*+{":
            q = self.take()
            if q == "{":
                close = self.text.index("}", self.at)
                low, comma, high = self.text[self.at:close].partition(",")
                self.at = close + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(q == "+"), 1 if q == "?" else None)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError("unclosed group")
            return node
        if c == "[":
            return ("set", self.char_class())
        return ("set", self.cased(1 << (self.escape() if c == "\\" else ord(c))))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2:self.at], 16)
        if c.isalnum():
            raise ValueError(f"unsupported escape \\{c}")
        return ord(c)

    def char_class(self) -> int:
        negated = self.peek() == "^"
        self.at += negated
        mask, first = 0, True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = high = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else ord(c)
            for b in range(low, high + 1):
                mask |= 1 << b
        self.take()
        mask = self.cased(mask)
        return ALL & ~mask if negated else mask

    def cased(self, mask: int) -> int:
        if self.any_case:
            for b in range(65, 91):
                if mask >> b & 1 or mask >> (b + 32) & 1:
                    mask |= 1 << b | 1 << (b + 32)
        return mask


def parse(text: str, any_case: bool = False):
    p = _Parser(text, any_case)
    node = p.alternatives()
    if p.at != len(text):
        raise ValueError(f"unexpected {text[p.at]!r} at {p.at}")
    return node


def reverse(node):
    """The expression of the reversed words."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    parts = [reverse(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.edges: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.edges.append(None)
        return len(self.free) - 1

    def add(self, node, at: int) -> int:
        """Path for ``node`` from state ``at``; its last state."""
        kind = node[0]
        if kind == "set":
            here, end = self.state(), self.state()
            self.free[at].append(here)
            self.edges[here] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                at = self.add(part, at)
            return at
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.free[self.add(part, at)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            at = self.add(inner, at)
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[at].append(end)
        for _ in range(most - least):
            at = self.add(inner, at)
            self.free[at].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton(NamedTuple):
    """``table[state + byte]`` is the next state; states are multiples of 256,
    those at or above ``floor`` accept the expressions in
    ``accepts[state >> 8]`` (bits), ``dead`` (or -1) leads nowhere."""
    table: np.ndarray
    start: int
    floor: int
    accepts: np.ndarray
    dead: int


def _byte_classes(masks) -> tuple[np.ndarray, list[int]]:
    """Class of each byte, and one byte of each class: bytes that no
    expression tells apart are one class."""
    ids: dict[tuple, int] = {}
    of, some = np.zeros(256, np.int64), []
    for b in range(256):
        key = tuple(m >> b & 1 for m in masks)
        if key not in ids:
            ids[key] = len(ids)
            some.append(b)
        of[b] = ids[key]
    return of, some


def compile_automaton(nodes: list, anywhere: bool = False) -> Automaton:
    """One minimal automaton for all ``nodes``; with ``anywhere`` a word may
    start at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = [nfa.add(node, start) for node in nodes]
    masks = sorted({e[0] for e in nfa.edges if e})
    of, some = _byte_classes(masks)

    # subset construction
    first = nfa.closure([start])
    number, todo, rows, accepts = {first: 0}, [first], [], []
    while todo:
        here = todo.pop(0)
        accepts.append(sum(1 << i for i, e in enumerate(ends) if e in here))
        row = []
        for b in some:
            step = {nfa.edges[s][1] for s in here if nfa.edges[s] and nfa.edges[s][0] >> b & 1}
            nxt = nfa.closure(step) | first if anywhere else nfa.closure(step)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    step, accepts = np.array(rows), np.array(accepts, np.int64)

    # minimisation: split classes of states until no byte tells two apart
    part = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    one = np.unique(part, return_index=True)[1]
    step, accepts, at = part[step[one]], accepts[one], part[0]

    order = np.argsort(accepts > 0, kind="stable")  # accepting states last
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    step, accepts = place[step[order]], accepts[order]
    floor = int((accepts == 0).sum())
    stuck = [i for i in range(floor) if (step[i] == i).all()]
    table = (step[:, of] * 256).astype(np.int32).ravel()
    return Automaton(table, int(place[at]) * 256, floor * 256, accepts, stuck[0] * 256 if stuck else -1)
