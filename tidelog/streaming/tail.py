"""A growing folder of log files as a stream of entries, and their counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.patterns import extracted
from tidelog.sources.profiles import Profile


def tail(spark: SparkSession, folder: str, profile: Profile, files_per_batch: int | None = None) -> DataFrame:
    """Opening lines of new files as ts_ms, ts, level_ord, level, the facets, message and raw_text.

    Files must arrive whole. Continuations are not folded: a stream gives no order of lines across batches.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    text = F.regexp_replace("value", "\r$", "")
    opening = reader.text(folder).select(text.alias("raw_text")).where(profile.parses(F.col("raw_text")))
    fields = extracted(F.col("raw_text"), profile.groups, list(profile.groups.numbers))
    ms = profile.time.millis(fields[profile.time_group])
    level = profile.level_ordinal(fields[profile.level_group]) if profile.level_group else profile.level_ordinal(F.lit(None))
    message = fields[profile.message_group] if profile.message_group else F.col("raw_text")
    out = opening.select(ms.alias("ts_ms"), F.timestamp_millis(ms).alias("ts"), level.alias("level_ord"), profile.level_name(level).alias("level"), *(fields[f.name].alias(f.name) for f in profile.facets), message.alias("message"), "raw_text")
    return out.where(F.col("ts_ms").isNotNull())


def level_windows(entries: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Entries of each level in each window of their own time; those later than the watermark are not counted."""
    counted = entries.withWatermark("ts", late).groupBy(F.window("ts", window), "level").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "level", "n")
