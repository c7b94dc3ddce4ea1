"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run of digests. In binomial rounds, FAN_IN runs at a time are exchanged, dealt by digest, so that no merge holds a whole run, and merged in digest order (a sort aggregate). Each round keeps, for each digest, the smallest identifier and the number of rows, after it has verified that the rows also agree in a second digest and the length. The last run tells every document which row of its group stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import kept_table, lookup

#: Runs that one merge takes in.
FAN_IN = 16

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A digest, a check and a run number for each row; _row tells rows of the same doc_id apart."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("t"))
    check = F.concat_ws("-", F.octet_length("t").cast("string"), F.hex(F.xxhash64("t")))
    return whole.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), check.alias("check"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("_row"))


def merge(part: DataFrame) -> DataFrame:
    """One round: the runs of a group of FAN_IN become one."""
    moved = part.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
    out = moved.groupBy("run", "digest").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("_most"))
    same = F.when(F.col("check") == F.col("_most"), F.col("check")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")))
    return out.withColumn("check", same).drop("_most")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs, dropped rows too.

    Texts are equal when identical after each run of ASCII white space has become one space; null counts as empty, and all empty texts form one group. The row with the smallest doc_id stays; of rows that tie on it, exactly one. A null doc_id comes last. Other columns of docs play no part, whatever their names. An empty table gives no rows.
    """
    rows = kept_table(runs(docs, doc_id, text), "digests")
    last = rows.agg(F.coalesce(F.max("run"), F.lit(0)).alias("run"), F.count(F.lit(1)).alias("n")).first()
    level = rows.select("run", "digest", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("least"), F.lit(1).cast("long").alias("n"), "check")
    most = last["run"]
    while True:
        level, most = merge(level), most // FAN_IN
        if not most:
            break
        level = kept_table(level, "run")
    final = kept_table(level.select("digest", "least", "n"), "groups")
    out = lookup(rows.select("doc_id", "digest", "_row"), final, ["digest"], "n", last["n"])
    return out.select("doc_id", F.col("least.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("least._row")).alias("kept"), F.col("digest").alias("text_sha256"))
