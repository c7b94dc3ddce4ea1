"""Lines to entries: classification, folding of continuations, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.patterns import group_values, joined, parts_of
from tidelog.sources.profiles import Profile

ENTRY, CONTINUATION, UNRECOGNISED = "entry", "continuation", "unrecognised"


def parsed(lines: DataFrame, profile: Profile) -> DataFrame:
    """Lines with _ms, the time of those that open an entry, and _fields, its groups; null on others.

    A time that can't be read (month 13) makes the line no opening.
    """
    names = list(profile.groups.numbers)
    line, parts = F.col("text"), F.col("_parts")
    # the pattern runs once, on lines that may open an entry; its result stays a column, so that nothing runs it again
    tried = lines.withColumn("_joined", F.when(profile.opens.column(line) if profile.opens else F.lit(True), joined(line, profile.groups, names)))
    found = tried.withColumn("_parts", F.when(F.col("_joined").isNotNull(), parts_of(F.col("_joined"), line, profile.groups, names))).drop("_joined")
    found = found.withColumn("_time", F.get(parts, F.lit(names.index(profile.time_group))))
    fields = F.struct(*(v.alias(k) for k, v in group_values(parts, line, profile.groups, names).items()))
    return found.withColumn("_ms", profile.time.millis(F.col("_time"))).withColumn("_fields", F.when(parts.isNotNull(), fields)).drop("_parts", "_time")


def classify(lines: DataFrame, profile: Profile) -> DataFrame:
    """Lines with _ms, _fields and kind: entry, continuation, section, notice or unrecognised.

    A line continues where an entry is open, which it is after the first line of the file that parses; else it opens an entry if it parses; else a marker names it.
    """
    return classify_parsed(parsed(lines, profile), profile)


def classify_parsed(found: DataFrame, profile: Profile) -> DataFrame:
    """The same from parsed(), which is read twice: a table saves parsing twice."""
    opens = F.col("_ms").isNotNull()
    first = found.groupBy("file_id").agg(F.min(F.when(opens, F.col("line_no"))).alias("_first"))
    known = found.join(F.broadcast(first), "file_id", "left")  # a row for each file
    kind = F.when(opens, F.lit(ENTRY)).otherwise(F.coalesce(profile.marks(F.col("text")), F.lit(UNRECOGNISED)))
    if profile.continues:
        kind = F.when((F.col("line_no") > F.col("_first")) & profile.continues.column(F.col("text")), F.lit(CONTINUATION)).otherwise(kind)
    return known.withColumn("kind", kind).drop("_first")


def fold(classified: DataFrame, profile: Profile) -> DataFrame:
    """Entries: an opening line and all up to its last continuation, what stands between included.

    Columns: file_id, file, block, seq (from 1 in the file), line_no, last_line_no, byte_offset, byte_length, ts_ms, ts, level_ord, level, the facets, message, continuations, raw_text.
    """
    is_entry, is_event = F.col("kind") == ENTRY, F.col("kind").isin(ENTRY, CONTINUATION)
    first = F.min(F.when(is_event, 2 * F.col("line_no") + (~is_entry).cast("int")))  # with its last bit a continuation
    counts = classified.groupBy("file_id", "block").agg(F.count(F.when(is_entry, 1)).alias("_n"), F.when(first % 2 == 0, ENTRY).when(first.isNotNull(), CONTINUATION).alias("_first"))
    file = Window.partitionBy("file_id")  # a row for each block
    before = F.coalesce(F.sum("_n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.last("_first", ignorenulls=True).over(file.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("file_id", "block", (before + F.col("_n")).alias("_upto"), later.alias("_later"))
    # from a block's end: the entries behind a line, and what stands next behind it
    behind = Window.partitionBy("file_id", "block").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    follows = F.coalesce(F.last(F.when(is_event, F.col("kind")), ignorenulls=True).over(behind), F.col("_later"))
    numbered = classified.join(counts, ["file_id", "block"]).withColumn("seq", F.col("_upto") - F.count(F.when(is_entry, 1)).over(behind)).withColumn("_follows", follows)
    # what stands behind an entry's last continuation is no part of it, however much it is
    held = numbered.where((F.col("seq") > 0) & (is_event | (F.col("_follows") == CONTINUATION)))
    part = F.struct("line_no", "raw", "text")
    grouped = held.groupBy("file_id", "file", "seq").agg(
        F.min("line_no").alias("line_no"),
        F.max("line_no").alias("last_line_no"),
        F.min(F.when(is_entry, F.col("byte_offset"))).alias("byte_offset"),
        F.first(F.when(is_entry, F.struct("_ms", "_fields", "text", "block")), ignorenulls=True).alias("_open"),
        F.array_sort(F.collect_list(part)).alias("_parts"),
    )
    last = F.element_at("_parts", -1)["text"]
    earlier = F.transform(F.slice("_parts", 1, F.size("_parts") - 1), lambda x: x["raw"])
    raw_text = F.when(F.size("_parts") == 1, last).otherwise(F.concat_ws("\n", F.array_join(earlier, "\n"), last))
    fields = F.col("_open._fields")
    level = profile.level_ordinal(fields[profile.level_group]) if profile.level_group else profile.level_ordinal(F.lit(None))
    message = fields[profile.message_group] if profile.message_group else F.col("_open.text")
    rest = F.slice(F.split(raw_text, "\n", -1), 2, F.size("_parts"))
    if profile.strip_indent:
        rest = F.transform(rest, lambda x: F.ltrim(x))
    facets = [fields[f.name].alias(f.name) for f in profile.facets]
    return grouped.select(
        "file_id", "file", F.col("_open.block").alias("block"), "seq", "line_no", "last_line_no", "byte_offset", F.octet_length(raw_text).alias("byte_length"),
        F.col("_open._ms").alias("ts_ms"), F.timestamp_millis("_open._ms").alias("ts"), level.alias("level_ord"), profile.level_name(level).alias("level"), *facets, message.alias("message"), rest.alias("continuations"), raw_text.alias("raw_text"),
    )


def counters(classified: DataFrame) -> DataFrame:
    """kind and n: how many lines of each kind."""
    return classified.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def recognised_ratio(lines: int, unrecognised: int) -> float:
    return (lines - unrecognised) / lines if lines else 1.0
