"""Text rules: ASCII case folding for search, any-case equality for values, indents, displays."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def contains_phrase(col: Column, phrase: str) -> Column:
    """The needle is folded as a whole, the text in ASCII only: a text's É is never found."""
    return F.contains(ascii_lower(col), F.lit(phrase.lower()))


def same_any_case(col: Column, value: str) -> Column:
    return F.lower(F.upper(col)) == value.upper().lower()


def contains_any_case(col: Column, value: str) -> Column:
    return F.contains(F.lower(F.upper(col)), F.lit(value.upper().lower()))


def padded(col: Column, width: int) -> Column:
    """Right-aligned in width, longer values whole."""
    return F.when(F.length(col) < width, F.lpad(col, width, " ")).otherwise(col)


def folded(message: Column, indent: str) -> Column:
    """Every line after the first behind the indent."""
    return F.regexp_replace(message, "\r\n|\r|\n", "\n" + indent)


def flattened(value: Column) -> Column:
    return F.translate(value, "\r\n", "  ")


#: Displays of a time: minute, day and minute, milliseconds, day, month and day, all, and what a query takes (fixed values).
DISPLAYS = {"minute": "HH:mm", "day_minute": "MM-dd HH:mm", "millisecond": "HH:mm:ss.SSS", "day": "yyyy-MM-dd", "month_day": "MM-dd", "full": "yyyy-MM-dd HH:mm:ss.SSS", "query": "yyyy-MM-dd'T'HH:mm:ss.SSS"}


def displayed(ts: Column, how: str) -> Column:
    """A timestamp in the session's zone."""
    return F.date_format(ts, DISPLAYS[how])


def query_instant(ms: int, zone: str) -> str:
    """How a query names an instant, to the millisecond."""
    at = datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=ms)
    return at.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}"


def epoch_day(ms: int, zone: str) -> int:
    at = datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=ms)
    return at.astimezone(ZoneInfo(zone)).toordinal() - datetime(1970, 1, 1).toordinal()


def spans_days(first_ms: int, last_ms: int, zone: str) -> bool:
    return epoch_day(first_ms, zone) != epoch_day(last_ms, zone)


def count_text(n: int, group: str = ",") -> str:
    return f"{n:,}".replace(",", group)


def severity(level_ord: Column, levels: int) -> Column:
    """The top of the scale is an error, the one below a warning."""
    return F.when(level_ord == levels - 1, "error").when((level_ord == levels - 2) & (level_ord >= 0), "warning").otherwise("plain")
