"""Ordered results: pages, positions, selection, copy, export, context, day changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT, COPY_CAP, EXPORT_STEP, BUCKETS = 20, 20_000, 50_000, 900
MOST_GRIDLINES = 40


def with_positions(matches: DataFrame, total_before: DataFrame | None = None) -> DataFrame:
    """Matches with pos, their place in the result from 0.

    entry_id cuts the entries into ranges of a fixed size; a match's place is the number of matches in the ranges before and its place in its own.
    """
    step = 1 << 16
    cut = matches.withColumn("_cut", F.floor(F.col("entry_id") / step))
    before = cut.groupBy("_cut").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = Window.partitionBy("_cut").orderBy("entry_id")
    return cut.join(before, "_cut").withColumn("pos", F.col("_before") + F.row_number().over(own) - 1).drop("_cut", "_before")


def page(results: DataFrame, first: int, size: int) -> DataFrame:
    """The rows of the result from a place on."""
    return results.where((F.col("pos") >= first) & (F.col("pos") < first + size)).orderBy("pos")


def position_of(results: DataFrame, entry_id: int) -> int:
    """The place of an entry in the result, -1 if it isn't there."""
    found = results.where(F.col("entry_id") == entry_id).select("pos").first()
    return found["pos"] if found else -1


def neighbourhood(entries: DataFrame, entry_id: int, radius: int = CONTEXT) -> DataFrame:
    """The entries around one, whatever the query."""
    return entries.where(F.col("entry_id").between(entry_id - radius, entry_id + radius)).orderBy("entry_id")


def day_changes(rows: DataFrame, zone: str = "UTC", order: str = "entry_id") -> DataFrame:
    """Rows with day and opens_day: the day differs from that of the row before in the result, and the first row.

    A row's predecessor is in its own range of ids, or is the last of the nearest range before that has rows.
    """
    step = 1 << 16
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("ts_ms"), zone)) if zone != "UTC" else F.date_from_unix_date(F.floor(F.col("ts_ms") / 86_400_000).cast("int"))
    cut = rows.withColumn("day", day).withColumn("_cut", F.floor(F.col(order) / step))
    ends = cut.groupBy("_cut").agg(F.max(F.struct(order, "day")).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.orderBy("_cut"))["day"]).select("_cut", "_before")
    own = Window.partitionBy("_cut").orderBy(order)
    before = F.coalesce(F.lag("day").over(own), F.col("_before"))
    return cut.join(ends, "_cut").withColumn("opens_day", before.isNull() | (before != F.col("day"))).drop("_cut", "_before")


def gridlines(first_ms: int, last_ms: int, zone: str) -> list[int]:
    """The day starts between the first and the last time, in milliseconds; none if there are more than MOST_GRIDLINES."""
    info = ZoneInfo(zone)
    day = datetime.fromtimestamp(first_ms / 1000, info).date()
    out = []
    while True:
        day += timedelta(days=1)
        at = int(datetime(day.year, day.month, day.day, tzinfo=info).timestamp() * 1000)
        if at > last_ms:
            return out
        if at > first_ms:
            out.append(at)
        if len(out) > MOST_GRIDLINES:
            return []


def brushed(first_ms: int, last_ms: int, start: float, end: float, width: float, least: float = 4.0) -> tuple[int, int] | None:
    """The instants that a brush from start to end covers on a strip of that width; None, which clears, for one too narrow."""
    low, high = sorted((start, end))
    if high - low < least:
        return None
    at = lambda x: first_ms + int(min(max(x / width, 0.0), 1.0) * (last_ms - first_ms))
    return at(low), at(high)


@dataclass(frozen=True)
class Selection:
    """A run of places in a result, from where it was begun to where it was drawn."""

    anchor: int
    focus: int

    @property
    def first(self) -> int:
        return min(self.anchor, self.focus)

    @property
    def last(self) -> int:
        return max(self.anchor, self.focus)

    @property
    def size(self) -> int:
        return self.last - self.first + 1

    @classmethod
    def at(cls, place: int) -> Selection:
        return cls(place, place)

    @classmethod
    def everything(cls, count: int) -> Selection | None:
        return cls(0, count - 1) if count else None

    def extended(self, place: int) -> Selection:
        return replace(self, focus=place)

    def moved(self, by: int, count: int, extend: bool = False) -> Selection:
        """One place further, no further than the ends."""
        focus = min(max(self.focus + by, 0), count - 1)
        return replace(self, focus=focus) if extend else Selection.at(focus)

    def within(self, count: int) -> Selection | None:
        """The same in a result of another size."""
        return Selection(min(self.anchor, count - 1), min(self.focus, count - 1)) if count else None


def copy(results: DataFrame, selection: Selection, cap: int = COPY_CAP) -> tuple[str, str | None]:
    """The selected entries' text, a line feed between, and a notice if the cap cut them. The cap bounds what the driver holds."""
    last = min(selection.last, selection.first + cap - 1)
    rows = results.where(F.col("pos").between(selection.first, last)).orderBy("pos").select("raw_text").collect()
    notice = f"Copied {len(rows)} of {selection.size} entries" if selection.size > cap else None
    return "\n".join(r["raw_text"] for r in rows), notice


def export(results: DataFrame, path: str, progress: Callable[[int], None] | None = None, single: bool = False) -> int:
    """Writes the text of every match in result order, without a cap, and returns their number.

    By default a folder of part files, each a range of the result; single streams the parts one after the other into one file on the driver.
    """
    ordered = results.orderBy("pos").select("raw_text")
    if not single:
        ordered.write.mode("overwrite").text(path)
        n = results.count()
        if progress:
            progress(n)
        return n
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as out:
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            out.write(row["raw_text"] + "\n")
            n += 1
            if progress and n % EXPORT_STEP == 0:
                progress(n)
    return n
