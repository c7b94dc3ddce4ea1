"""Java patterns: their named groups, one-pass extraction as a Column, and line predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between extracted groups; a line that holds it is extracted group by group instead.
SEPARATOR = "\x01"

_PIECE = re.compile(r"\\Q.*?(?:\\E|\Z)|\\.|\[|\]|\((?:\?(?:<(?P<name>[a-zA-Z][a-zA-Z0-9]*)>|<[=!]|[:=!>]|[a-zA-Z-]*[:)]))?|\)|.", re.S)


class PatternError(ValueError):
    """A pattern that Java does not compile, or with a group named twice."""


def java_error(source: str) -> str | None:
    """What Java says against a pattern, or None. Without a running JVM Python's dialect stands in."""
    context = SparkContext._active_spark_context
    if context is None:
        try:
            re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", source))
        except re.error as error:
            return str(error)
        return None
    try:
        context._jvm.java.util.regex.Pattern.compile(source)
    except Exception as error:  # noqa: BLE001  py4j wraps Java's exception
        java = getattr(error, "java_exception", None)
        return java.getDescription() if java is not None and hasattr(java, "getDescription") else str(error).split("\n")[0]
    return None


@dataclass
class Groups:
    """The capturing groups of a pattern."""

    source: str
    #: Number of each named group.
    numbers: dict[str, int] = field(default_factory=dict)
    #: Where in the source each named group's content begins.
    begins: dict[str, int] = field(default_factory=dict)
    count: int = 0

    @classmethod
    def of(cls, source: str) -> Groups:
        found, depth = cls(source), 0  # depth: of character classes, which Java nests
        for m in _PIECE.finditer(source):
            piece = m[0]
            if piece == "[":
                depth += 1
            elif piece == "]":
                depth = max(0, depth - 1)
            elif piece.startswith("(") and not depth and (piece == "(" or m["name"]):
                found.count += 1
                if m["name"]:
                    if m["name"] in found.numbers:
                        raise PatternError(f"group '{m['name']}' is named twice")
                    found.numbers[m["name"]] = found.count
                    found.begins[m["name"]] = m.end()
        return found

    def whole(self) -> str:
        """The pattern for a full match of a line, line feeds included."""
        return rf"(?s)\A(?:{self.source})\z"

    def presence(self, name: str) -> str:
        """A pattern that a line matches in full with the group taking part.

        An empty group right behind the group's opening takes part exactly when it does, and a reference to a group that doesn't fails; the atomic group keeps the engine from another way to match.
        """
        at = self.begins[name]
        marked = self.source[:at] + "(?<tidemark>)" + self.source[at:]
        return rf"(?s)\A(?>(?:{marked})\z)\k<tidemark>"


def joined(line: Column, groups: Groups, names: list[str]) -> Column:
    """The named groups of a line behind separators, from one run of the pattern; a line that doesn't match, or holds the separator, as it is."""
    parts = "".join(f"{SEPARATOR}${groups.numbers[n]}" for n in names)
    return F.when(F.contains(line, F.lit(SEPARATOR)), line).otherwise(F.regexp_replace(line, F.lit(groups.whole()), F.lit(parts)))


def parts_of(found: Column, line: Column, groups: Groups, names: list[str]) -> Column:
    """The groups as an array, '' for those that take no part, from what joined() made of the line; null if it doesn't match. A line with the separator is matched group by group."""
    odd = F.contains(line, F.lit(SEPARATOR))
    apart = F.when(line.rlike(groups.whole()), F.array(*(F.regexp_extract(line, groups.whole(), groups.numbers[n]) for n in names)))
    return F.when(odd, apart).when(F.startswith(found, F.lit(SEPARATOR)), F.slice(F.split(found, SEPARATOR, -1), 2, len(names)))


def group_values(parts: Column, line: Column, groups: Groups, names: list[str]) -> dict[str, Column]:
    """Each group of a line that matches: null where it takes no part, '' where it is empty."""
    out = {}
    for k, name in enumerate(names):
        value = F.get(parts, F.lit(k))
        out[name] = F.when(value != "", value).when(line.rlike(groups.presence(name)), F.lit(""))
    return out


def extracted(line: Column, groups: Groups, names: list[str]) -> dict[str, Column]:
    """The named groups of a line that matches."""
    return group_values(parts_of(joined(line, groups, names), line, groups, names), line, groups, names)


@dataclass(frozen=True)
class LinePredicate:
    """A test at the start of a line. literal: the line must start with it. Otherwise pattern is searched."""

    literal: str | None
    pattern: str | None

    @property
    def cheap(self) -> bool:
        return self.literal is not None

    def column(self, line: Column) -> Column:
        return line.startswith(self.literal) if self.literal is not None else line.rlike(self.pattern)


#: One thing that a line can be held to at a fixed place: a digit, or one character written plainly or behind a backslash.
_ATOM = re.compile(r"(?:(?P<digit>\\d)|\\(?P<tab>t)|\\(?P<escaped>[\\^$.|?*+()\[\]{}\-/\"'])|(?P<plain>[^\\^$.|?*+()\[\]{}]))(?:\{(?P<times>[^}]*)\})?", re.S)


def _atoms(source: str) -> tuple[list[str | None], bool]:
    """What the first characters must be (None: a digit), as far as that can be told, and whether it could be told to the end."""
    out: list[str | None] = []
    at = 1
    while m := _ATOM.match(source, at):
        times = m["times"]
        if times is not None and not times.isdigit():
            return out, False
        out += [None if m["digit"] else "\t" if m["tab"] else m["escaped"] or m["plain"]] * (1 if times is None else int(times))
        at = m.end()
    return out, at == len(source)


def continuation_test(source: str) -> LinePredicate:
    """Exactly what the pattern finds: a literal start if that is all it says, else a search."""
    if source.startswith("^"):
        atoms, whole = _atoms(source)
        if whole and atoms and None not in atoms:
            return LinePredicate("".join(atoms), None)
    return LinePredicate(None, source)


def opening_test(source: str) -> LinePredicate | None:
    """A necessary condition from the fixed places that the pattern begins with; None if it has none."""
    if not source.startswith("^"):
        return None
    atoms, _ = _atoms(source)
    usable: list[str | None] = []
    for a in atoms:
        if a is not None and not a.isascii():
            break  # takes more than one byte, so the places behind it aren't fixed
        usable.append(a)
    if not usable:
        return None
    return LinePredicate(None, "^" + "".join("[0-9]" if a is None else re.escape(a) if not a.isalnum() else a for a in usable))
