"""Parsing-expression grammars: ordered choice, greedy repetition, no backtracking into a success.

An expression is a function ``(text, position) -> (position, nodes) | None``. A node is
``(rule, start, end, children)``; only named rules make nodes. The outcome of a rule at a position is kept for
the whole parse (packrat), so no rule is tried twice at one place. A rule that contains itself names the
characters that open it: it is then parsed at every opener from the last to the first, so the rules inside are
always known already, and neither time nor depth grows with the nesting.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Node = tuple[str, int, int, list]
Expr = Callable[[str, int], "tuple[int, list[Node]] | None"]


def term(pattern: str) -> Expr:
    match = re.compile(pattern).match

    def run(text: str, at: int):
        m = match(text, at)
        return (m.end(), []) if m else None

    return run


def seq(*parts: Expr) -> Expr:
    def run(text: str, at: int):
        nodes: list[Node] = []
        for p in parts:
            if (r := p(text, at)) is None:
                return None
            at = r[0]
            nodes += r[1]
        return at, nodes

    return run


def first(*parts: Expr) -> Expr:
    def run(text: str, at: int):
        for p in parts:
            if (r := p(text, at)) is not None:
                return r
        return None

    return run


def opt(part: Expr) -> Expr:
    return lambda text, at: part(text, at) or (at, [])


def many(part: Expr) -> Expr:
    def run(text: str, at: int):
        nodes: list[Node] = []
        while (r := part(text, at)) is not None and r[0] > at:
            at = r[0]
            nodes += r[1]
        return at, nodes

    return run


class Grammar:
    """Named rules that may refer to one another before they are defined."""

    def __init__(self) -> None:
        self.rules: dict[str, Expr] = {}
        self.opened: list[tuple[str, re.Pattern]] = []
        self.known: dict[tuple[str, int], tuple[int, list[Node]] | None] = {}

    def define(self, name: str, body: Expr, openers: str | None = None) -> Expr:
        """``openers``: the pattern of the characters at which a rule that contains itself may begin."""
        self.rules[name] = body
        if openers:
            self.opened.append((name, re.compile(openers)))
        return self.ref(name)

    def ref(self, name: str) -> Expr:
        def run(text: str, at: int):
            key = (name, at)
            if key not in self.known:
                r = self.rules[name](text, at)
                self.known[key] = None if r is None else (r[0], [(name, at, r[0], r[1])])
            return self.known[key]

        return run

    def parse(self, name: str, text: str) -> Node | None:
        self.known = {}
        try:
            for rule, openers in self.opened:
                again = self.ref(rule)
                for at in [m.start() for m in openers.finditer(text)][::-1]:
                    again(text, at)
            r = self.ref(name)(text, 0)
            return r[1][0] if r else None
        finally:
            self.known = {}
