"""Condition strings and their parsed form.

A condition is one comparison `term op term` or `Or(comparison, comparison, ...)`; a list of conditions is their conjunction. A
term is a constant or, where it starts with an ASCII letter, a variable. The right term is all that follows the operator.
"""

from __future__ import annotations

import re
from typing import NamedTuple

NO_PATH = "nopath"
_ATOM = re.compile(r"\s*(\S+)\s*(==|!=|<=|>=|<|>)\s*(.*?)\s*$", re.S)
_FLIP = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


class Atom(NamedTuple):
    left: str
    op: str
    right: str

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"

    def negated(self) -> Atom:
        return Atom(self.left, _FLIP[self.op], self.right)


#: A disjunction of atoms.
Condition = tuple[Atom, ...]


def variable(term: str) -> bool:
    return term[:1].isascii() and term[:1].isalpha()


def _unquoted(term: str) -> str:
    return term[1:-1] if len(term) > 1 and term[0] == term[-1] and term[0] in "\"'" else term


def atom(text: str) -> Atom:
    m = _ATOM.match(text)
    if not m:
        raise ValueError(f"not a comparison: {text!r}")
    return Atom(m[1], m[2], _unquoted(m[3]))


def parse(text: str) -> Condition:
    t = text.strip()
    if t.startswith("Or(") and t.endswith(")"):
        return tuple(atom(p) for p in _parts(t[3:-1]))
    return (atom(t),)


def _parts(text: str) -> list[str]:
    """Cut at commas outside quotes and brackets."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]
