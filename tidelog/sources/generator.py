"""A seeded synthetic log: weighted categories and levels, multi-line entries, odd shapes; any size, in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("Sync", "Ui", "Wpp", "Ble", "Db", "Net", "Push", "Auth")
WEIGHTS = {"V": 20, "D": 45, "I": 25, "W": 8, "E": 2}


def _roll(seed: int, what: int) -> Column:
    """A number below 10000 that the row and the question fix."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(what)), F.lit(10_000))


def generate(spark: SparkSession, entries: int, seed: int = 42, start_ms: int = 1_780_380_000_000) -> DataFrame:
    """id and text, the lines of an entry joined by line feeds, for each of the entries in time order."""
    rows = spark.range(entries)
    ts = F.date_format(F.timestamp_millis(F.lit(start_ms) + F.col("id") * 30 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(29))), "yyyy-MM-dd HH:mm:ss.SSS")
    roll, upto, level = _roll(seed, 1), 0, F.lit("E")
    picks = []
    for name, weight in WEIGHTS.items():
        upto += weight * 100
        picks.append((upto, name))
    for most, name in reversed(picks):
        level = F.when(roll < most, F.lit(name)).otherwise(level)
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (_roll(seed, 2) % len(CATEGORIES) + 1).cast("int"))
    tag = F.when(_roll(seed, 3) < 6000, F.concat(F.lit("o"), F.hex(_roll(seed, 4) % 800))).otherwise(F.concat(F.lit("Tag"), (_roll(seed, 4) % 15).cast("string")))
    message = F.concat(F.when(_roll(seed, 5) < 1000, F.lit("connected ")).otherwise(F.lit("step ")), F.when(_roll(seed, 6) < 100, F.lit("Résumé ")).otherwise(F.lit("")), F.lit("n="), F.col("id"))
    head = F.concat(ts, F.lit(" ["), level, F.lit("] "), F.when(_roll(seed, 7) < 300, F.lit("")).otherwise(F.concat(F.lit("["), category, F.lit("] "))), F.lit("["), tag, F.lit("] -> "), message)
    more = F.when(_roll(seed, 8) < 100, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.concat(F.lit("\n" + " " * 23 + "at frame."), k)), "")).when(_roll(seed, 8) < 600, F.lit("\n" + " " * 23 + "more")).otherwise(F.lit(""))
    return rows.select("id", F.concat(head, more).alias("text"))
