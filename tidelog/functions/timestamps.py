"""Time patterns of a format as Columns of epoch milliseconds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of fixed width: name and allowed widths (fixed values of the pattern language).
_FIXED = {"y": ("year", (4,)), "M": ("month", (2,)), "d": ("day", (2,)), "H": ("hour", (2,)), "m": ("minute", (2,)), "s": ("second", (2,)), "S": ("fraction", tuple(range(1, 10)))}
#: English month names, as formats without a locale write them (fixed values).
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

_ITEM = re.compile(r"''|'(?P<quoted>[^']*)'|(?P<letters>([A-Za-z])\3*)|(?P<other>[^A-Za-z'])")


class FormatError(ValueError):
    """A time pattern that can't be used."""


def local_zone() -> str:
    """The machine's zone."""
    try:
        with open("/etc/timezone") as f:
            return f.read().strip() or "UTC"
    except OSError:
        return "UTC"


def zone_of(spec: str | None, local: str) -> str:
    low = (spec or "local").lower()
    return local if low == "local" else "UTC" if low == "utc" else spec


@dataclass(frozen=True)
class Slot:
    field: str
    offset: int
    width: int


@dataclass(frozen=True)
class TimestampFormat:
    """A compiled pattern. slots: for patterns of fixed-width numbers; else items, the pattern's pieces."""

    pattern: str
    zone: str
    year: int
    assumes_year: bool
    slots: tuple[Slot, ...] | None
    items: tuple[tuple[str, str], ...]

    @classmethod
    def compile(cls, pattern: str, zone: str | None, assume_year: int | None = None, local: str = "UTC", now: datetime | None = None) -> TimestampFormat:
        name = zone_of(zone, local)
        try:
            info = ZoneInfo(name)
        except Exception as error:
            raise FormatError(f"zone '{zone}' is not known") from error
        year = assume_year or (now.astimezone(info) if now else datetime.now(info)).year
        items, at = [], 0
        while at < len(pattern):
            m = _ITEM.match(pattern, at)
            if not m:
                raise FormatError(f"'{pattern}' has a quote that does not end")
            at = m.end()
            items.append(("letters", m["letters"]) if m["letters"] else ("text", "'" if m[0] == "''" else m["quoted"] if m["quoted"] is not None else m["other"]))
        slots = _slots(items)
        if slots is None:
            _check(pattern, items)
        elif not slots:
            raise FormatError(f"'{pattern}' has no field")
        return cls(pattern, name, year, not any(kind == "letters" and x[0] in "yu" for kind, x in items), slots and tuple(slots), tuple(items))

    @property
    def is_fixed(self) -> bool:
        return self.slots is not None

    def millis(self, text: Column) -> Column:
        """Epoch milliseconds, null where the text can't be read."""
        return self._fixed(text) if self.slots is not None else self._formatted(text)

    def _fixed(self, text: Column) -> Column:
        # a slot that the text is too short for keeps its default: the tail of the pattern is optional
        read = {}
        for s in self.slots:
            digits = F.substring(text, s.offset + 1, s.width)
            read[s.field] = F.when(F.length(text) >= s.offset + s.width, digits.try_cast("int")), s.width
        get = lambda name, default: _default(read[name][0], text, self.slots, name, default) if name in read else F.lit(default)
        fraction = get("fraction", 0)
        width = read["fraction"][1] if "fraction" in read else 3
        millis = fraction * 10 ** (3 - width) if width <= 3 else F.floor(fraction / 10 ** (width - 3))
        return self._instant(get("year", self.year), get("month", 1), get("day", 1), get("hour", 0), get("minute", 0), get("second", 0), millis)

    def _instant(self, year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, millis: Column) -> Column:
        # the hour is resolved in the zone (forward over a gap, the earlier of two), minutes and the rest are added
        start = F.try_make_timestamp(year, month, day, hour, F.lit(0), F.lit(0), F.lit(self.zone))
        return (F.unix_millis(start) + minute * 60000 + second * 1000 + millis).cast("long")

    def _formatted(self, text: Column) -> Column:
        letters = [x for kind, x in self.items if kind == "letters"]
        if any(x[0] in "XxZzVO" for x in letters):  # an offset in the text is an instant
            joined = re.sub(r"p+", "", self.pattern)
            squeezed = F.regexp_replace(text, " +", " ")
            year = F.concat(F.lit(f"{self.year} "), squeezed) if self.assumes_year else squeezed
            stamp = F.try_to_timestamp(year, F.lit(("yyyy " if self.assumes_year else "") + joined))
            return F.unix_millis(stamp)
        pattern, fields = "", []
        for kind, x in self.items:
            if kind == "text":
                pattern += re.escape(x) if not x.isspace() else r"\s+"
            elif x[0] == "p":
                pattern += r"\s*"
            else:
                fields.append(x)
                pattern += {"M": r"(\d{1,2})" if len(x) < 3 else r"([A-Za-z]+)", "y": r"(\d{2,4})" if len(x) == 2 else r"(\d{4,})", "u": r"(\d{4,})", "S": rf"(\d{{{len(x)}}})", "a": r"([AaPp][Mm])"}.get(x[0], r"(\d{1,2})")
        whole = rf"\A{pattern}\z"
        part = lambda k: F.regexp_extract(text, whole, k + 1)
        number = {x[0]: part(k).try_cast("int") for k, x in enumerate(fields) if x[0] != "a" and not (x[0] == "M" and len(x) > 2)}
        for k, x in enumerate(fields):
            if x[0] == "M" and len(x) > 2:
                names = [m[:3] if len(x) == 3 else m for m in _MONTHS]
                number["M"] = reduce(lambda acc, m: acc.when(part(k) == m[1], F.lit(m[0] + 1)), enumerate(names), F.when(F.lit(False), F.lit(0)))  # noqa: B023
            if x[0] == "a":
                number["H"] = number.get("h", F.lit(12)) % 12 + F.when(F.lower(part(k)) == "pm", F.lit(12)).otherwise(F.lit(0))
        year = number.get("y", number.get("u", F.lit(self.year)))
        if "yy" in fields:
            year = year + 2000
        width = next((len(x) for x in fields if x[0] == "S"), 3)
        fraction = number.get("S", F.lit(0))
        millis = fraction * 10 ** (3 - width) if width <= 3 else F.floor(fraction / 10 ** (width - 3))
        zero = F.lit(0)
        at = self._instant(year, number.get("M", F.lit(1)), number.get("d", F.lit(1)), number.get("H", zero), number.get("m", zero), number.get("s", zero), millis)
        return F.when(text.rlike(whole), at)


def _default(read: Column, text: Column, slots: tuple[Slot, ...], name: str, default: int) -> Column:
    slot = next(s for s in slots if s.field == name)
    return F.when(F.length(text) < slot.offset + slot.width, F.lit(default)).otherwise(read)


def _slots(items: list[tuple[str, str]]) -> list[Slot] | None:
    """Where each number stands, or None if a field has no fixed width."""
    out, at = [], 0
    for kind, x in items:
        if kind == "letters":
            name, widths = _FIXED.get(x[0], ("", ()))
            if len(x) not in widths or any(s.field == name for s in out):
                return None
            out.append(Slot(name, at, len(x)))
        at += len(x)
    return out


def _check(pattern: str, items: list[tuple[str, str]]) -> None:
    bad = sorted({x[0] for kind, x in items if kind == "letters"} - set("yuMdHhmsSapXxZzVOE"))
    if bad:
        raise FormatError(f"'{pattern}' uses {', '.join(bad)}, which is not a field of a time")
