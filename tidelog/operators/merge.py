"""Many files as one stream: the order of a k-way merge by time, which never sorts inside a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order of the merged stream; in one file it is the order of the file.
MERGE_KEYS = ["merge_ms", "file_id", "seq"]


def merge_time(entries: DataFrame) -> DataFrame:
    """Entries with merge_ms, the latest time in the file up to the entry.

    A merge takes the file whose next entry is earliest, and of equal ones the first; an entry behind a later one of its file waits for that one. So it stands where the running maximum does. The maximum of the blocks before comes from a table of one row for each block.
    """
    blocks = entries.groupBy("file_id", "block").agg(F.max("ts_ms").alias("_most"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_id", "block", F.max("_most").over(before).alias("_most"))
    own = Window.partitionBy("file_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return entries.join(blocks, ["file_id", "block"]).withColumn("merge_ms", F.greatest(F.max("ts_ms").over(own), F.col("_most"))).drop("_most")
