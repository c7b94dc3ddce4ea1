"""Tables in the folder that driver and executors share, and global positions."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that this driver has made and not yet dropped.
_made: dict[str, None] = {}

#: With this setting, Spark deletes the shuffle files of a query when it ends, not when the driver's memory is next cleaned.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir; on a single machine a temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    where = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full.replace("file:/", "file:///", 1).rstrip("/") if re.match("file:/[^/]", full) else full.rstrip("/")


def fresh_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A path in the shared folder that nothing uses yet; unless it is lasting, it goes when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    if not lasting:
        _made[path] = None
        atexit.register(_quietly, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def _quietly(spark: SparkSession, path: str) -> None:
    if path in _made:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table, and its path: this cuts the lineage, and a lost executor takes nothing with it. It goes when the driver ends, if not before; the shuffle files of the write go with it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path), path


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What make gives, as a table, and its path; the tables that it made on the way are dropped."""
    before = {*_made}
    out, path = stored(make(), name)
    for other in [p for p in _made if p not in before and p != path]:
        drop(spark, other)
    return out, path


def numbered(df: DataFrame, keys: list[str], name: str, column: str = "entry_id", cheap: bool = False) -> tuple[DataFrame, str]:
    """df with each row's place in the order of keys, from 0, on a table; and the table's path.

    Rows are dealt by ranges and sorted there, and stored with their range and their place in it, which Spark's running id holds. A row's place is that, after the rows of the ranges before, which a small table tells. No range holds all rows. What df computes is stored first, as finding the ranges reads it once more; a cheap df is computed twice instead.
    """
    spark = df.sparkSession
    base, first = (df, None) if cheap else stored(df, f"{name}-unordered")
    ranges = base.repartitionByRange(*(F.col(k) for k in keys)).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    table, path = stored(ranges, name)
    if first:
        drop(spark, first)
    part = F.shiftright("_place", 33).cast("int")
    sizes = table.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # a row for each range
    before, upto = [], 0
    for r in sizes:
        before.append((r["_part"], upto))
        upto += r["count"]
    known = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    placed = table.withColumn("_part", part).join(known, "_part")
    return placed.withColumn(column, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_place"), path
