"""Counts of the sidebar and the timeline, each control with its own constraint lifted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.compiler import CompiledQuery, Facet

#: Values that a facet shows, and that it shows when searched or expanded.
SHOWN, EXPANDED = 8, 40


def bucket(ts_ms: Column, first_ms: int, last_ms: int, buckets: int) -> Column:
    """The bucket of a time between the source's first and last; null where all times are one."""
    if last_ms <= first_ms:
        return F.lit(None).cast("long")
    wide = (ts_ms - first_ms) * buckets
    return F.least(F.floor((wide - F.pmod(wide, F.lit(last_ms - first_ms))) / (last_ms - first_ms)).cast("long"), F.lit(buckets - 1).cast("long"))


def facet_counts(entries: DataFrame, query: CompiledQuery, facet: str) -> DataFrame:
    """value and n; entries without the facet are not counted."""
    return entries.where(query.without_facet(facet) & F.col(facet).isNotNull()).groupBy(F.col(facet).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def level_counts(entries: DataFrame, query: CompiledQuery) -> DataFrame:
    """level_ord and n; unknown levels are not counted."""
    return entries.where(query.without_levels() & (F.col("level_ord") >= 0)).groupBy("level_ord").agg(F.count(F.lit(1)).alias("n"))


def timeline(entries: DataFrame, query: CompiledQuery, first_ms: int, last_ms: int, buckets: int) -> DataFrame:
    """level_ord, bucket and n, the time window lifted; unknown levels are not drawn."""
    return histogram(entries.where(query.without_window()), first_ms, last_ms, buckets)


def histogram(entries: DataFrame, first_ms: int, last_ms: int, buckets: int) -> DataFrame:
    """level_ord, bucket and n of the entries as they are; the bounds are those of the whole source."""
    at = entries.where(F.col("level_ord") >= 0).withColumn("bucket", bucket(F.col("ts_ms"), first_ms, last_ms, buckets))
    return at.where(F.col("bucket").isNotNull()).groupBy("level_ord", "bucket").agg(F.count(F.lit(1)).alias("n"))


def sidebar(entries: DataFrame, query: CompiledQuery, facets: Sequence[Facet], first_ms: int, last_ms: int, buckets: int) -> DataFrame:
    """control, value, bucket and n of every control, in one scan.

    control is 'level', 'timeline' or 'facet:' and a name; value is a facet's value or a level's place in the scale as text.
    """
    known = F.col("level_ord") >= 0
    none = F.lit(None).cast("long")
    level = F.col("level_ord").cast("string")
    rows = [("level", level, none, query.without_levels() & known), ("timeline", level, bucket(F.col("ts_ms"), first_ms, last_ms, buckets), query.without_window() & known)]
    rows += [(f"facet:{f.name}", F.col(f.name).cast("string"), none, query.without_facet(f.name) & F.col(f.name).isNotNull()) for f in facets]
    made = F.array(*(F.struct(F.lit(c).alias("control"), v.alias("value"), b.alias("bucket"), (p if c != "timeline" else p & b.isNotNull()).alias("pass")) for c, v, b, p in rows))
    return entries.select(F.inline(made)).where("pass").groupBy("control", "value", "bucket").agg(F.count(F.lit(1)).alias("n"))


def dictionary(entries: DataFrame, facet: str, order: Sequence[str]) -> DataFrame:
    """value, total and the first entry that has it: the most frequent first, ties by first seen."""
    found = entries.where(F.col(facet).isNotNull()).groupBy(F.col(facet).alias("value")).agg(F.count(F.lit(1)).alias("total"), F.min(F.struct(*order)).alias("first"))
    return found.orderBy(F.desc("total"), "first")


def zero_filled(counts: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return keys.join(counts, list(on), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_values(totals: DataFrame, counts: DataFrame, selected: Sequence[str] = (), search: str = "", expanded: bool = False, mode: str = "auto") -> tuple[DataFrame, int]:
    """What the sidebar lists of a facet, and how many more there are.

    Order is by total, not by the count shown; values without a count stay if selected. A facet of mode auto with more than SHOWN values lists SHOWN, or EXPANDED when searched or expanded; others list all.
    """
    joined = totals.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    listed = joined.where((F.col("n") > 0) | F.col("value").isin(list(selected)))
    if search:
        listed = listed.where(F.contains(F.lower("value"), F.lit(search.lower())))
    several = totals.count()
    n = listed.count()
    ordered = listed.orderBy(F.desc("total"), "first")
    if mode != "auto" or several <= SHOWN:
        return ordered, 0
    limit = EXPANDED if search or expanded else SHOWN
    return ordered.limit(limit), max(0, n - limit)


def peak(line: DataFrame) -> DataFrame:
    """peak: the largest bucket of a timeline over all levels, 1 at least."""
    return line.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(1)).alias("peak"))


def facet_peak(counts: DataFrame) -> DataFrame:
    """peak: the largest count of a facet's values, 0 without any."""
    return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak"))
