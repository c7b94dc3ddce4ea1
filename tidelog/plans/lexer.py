"""Tokens of a query: field terms, phrases and patterns, each with its place in the text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum


class Comparison(Enum):
    EQUALS, AT_LEAST, AT_MOST, ABOVE, BELOW = "=", ">=", "<=", ">", "<"


@dataclass(frozen=True)
class Token:
    start: int
    end: int


@dataclass(frozen=True)
class Phrase(Token):
    text: str


@dataclass(frozen=True)
class Pattern(Token):
    source: str


@dataclass(frozen=True)
class Field(Token):
    name: str
    comparison: Comparison
    value: str
    negated: bool

    def raw_values(self) -> list[str]:
        """The values between commas, as written; a comma in quotes separates too."""
        return [x for x in self.value.split(",") if x.strip()]

    def values(self) -> list[str]:
        """The values without the white space and quotes around them."""
        return [y for x in self.value.split(",") if (y := x.strip().strip("\"'"))]


_TOKEN = re.compile(
    r"""(?P<quote>["'])(?P<phrase>.*?)(?:(?P=quote)|\Z)
    |/(?P<pattern>(?:\\.|[^/\\])*+(?:\\\Z)?)(?:/|\Z)
    |(?P<bare>(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'])+)""",
    re.S | re.X,
)
_FIELD = re.compile(r"(?P<name>[\w-]*)(?P<sign>>=|<=|[:=<>])(?P<value>.*)", re.S)
_SIGNS = {c.value: c for c in Comparison} | {":": Comparison.EQUALS}


def tokenize(query: str) -> list[Token]:
    """Every query has tokens: quotes and patterns that don't end run to the end of the text."""
    out: list[Token] = []
    for m in _TOKEN.finditer(query):
        span = m.start(), m.end()
        if m["phrase"] is not None:
            out.append(Phrase(*span, m["phrase"]))
        elif m["pattern"] is not None:
            out.append(Pattern(*span, m["pattern"]))
        else:
            raw = m["bare"]
            negated = len(raw) > 1 and raw[0] == "-"
            body = raw[1:] if negated else raw
            field = _FIELD.fullmatch(body)
            # without a field the sign has no meaning: -word searches for word
            out.append(Field(*span, field["name"], _SIGNS[field["sign"]], field["value"], negated) if field else Phrase(*span, body))
    return out
