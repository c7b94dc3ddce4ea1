"""Query text edited by what a user ticks or brushes; the text is the only state of a selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from tidelog.plans.lexer import Comparison, Field, tokenize


def _editable(query: str, name: str) -> list[Field]:
    """Terms of the field that list values: not negated, equal or at least."""
    return [t for t in tokenize(query) if isinstance(t, Field) and t.name.lower() == name.lower() and not t.negated and t.comparison in (Comparison.EQUALS, Comparison.AT_LEAST)]


def _rank(scale: Sequence[str], value: str) -> int | None:
    return next((k for k, x in enumerate(scale) if x.lower() == value.lower()), None)


def _selected(terms: list[Field], scale: Sequence[str] | None) -> list[str]:
    out: dict[str, None] = {}
    for term in terms:
        values = term.values()
        if scale is not None and term.comparison is Comparison.AT_LEAST:
            low = _rank(scale, values[0]) if values else None
            values = list(scale[low:]) if low is not None else values
        out.update(dict.fromkeys(values))
    return list(out)


def _written(name: str, values: list[str], scale: Sequence[str] | None) -> str:
    if not values:
        return ""
    if scale is None:
        return f"{name}:{','.join(values)}"
    ranks = sorted(r for v in values if (r := _rank(scale, v)) is not None)
    if len(ranks) > 1 and ranks == list(range(ranks[0], len(scale))):
        return f"{name}>={scale[ranks[0]]}"
    return f"{name}:{','.join(scale[r] for r in ranks)}"


def _spliced(query: str, terms: list[Field], text: str) -> str:
    """text in the place of the first term, the other terms gone; at the end if there is none."""
    if not terms:
        return query if not text else f"{query.rstrip()} {text}" if query.strip() else text
    pieces, at = [], 0
    for k, term in enumerate(terms):
        pieces += [query[at : term.start], "" if k else text]
        at = term.end
    return re.sub(" {2,}", " ", ("".join(pieces) + query[at:]).strip())


def toggle(query: str, name: str, value: str, scale: Sequence[str] | None = None) -> str:
    """The query with the value added to the field's terms, or taken from them; scale: the levels in ascending order."""
    terms = _editable(query, name)
    now = _selected(terms, scale)
    left = [v for v in now if v.lower() != value.lower()]
    return _spliced(query, terms, _written(name, left if len(left) < len(now) else [*now, value], scale))


def clear(query: str, name: str) -> str:
    return _spliced(query, _editable(query, name), "")


def set_window(query: str, since: str | None, until: str | None) -> str:
    """The query with these bounds; None takes a bound away."""
    for name, bound in (("since", since), ("until", until)):
        query = _spliced(query, _editable(query, name), f"{name}:{bound}" if bound is not None else "")
    return query


def selected(query: str, name: str, scale: Sequence[str] | None = None) -> set[str]:
    """What the query selects of a field."""
    return set(_selected(_editable(query, name), scale))
