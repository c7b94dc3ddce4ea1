"""Text files as lines in file order, with numbers and byte offsets, across any number of splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class File:
    file_id: int
    name: str
    path: str


def _hidden(path: str) -> bool:
    """Spark's readers silently skip such names."""
    return path.rsplit("/", 1)[-1].startswith(("_", "."))


def _escaped(path: str) -> str:
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in path)


def _uri(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


def raw_lines(spark: SparkSession, files: list[File]) -> DataFrame:
    """file_id, file, block, at (ascending in a block) and raw, the line without its line feed."""
    plain, hidden = [f for f in files if not _hidden(f.path)], [f for f in files if _hidden(f.path)]
    out = None
    if plain:
        read = spark.read.option("lineSep", "\n").text([_escaped(f.path) for f in plain])
        found = read.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
        # file_path is percent-encoded, with the same rules as a URI of Hadoop's
        names = spark.createDataFrame([(_uri(spark, f.path), f.file_id, f.name) for f in plain], "uri string, file_id int, file string")
        names = names.withColumn("uri", F.regexp_replace("uri", "^file:/+", "file:///"))
        found = found.withColumn("uri", F.regexp_replace("uri", "^file:/+", "file:///"))
        out = found.join(F.broadcast(names), "uri").select("file_id", "file", "block", "at", "raw")  # a row for each file
    if hidden:
        other = _read_whole(spark, hidden)
        out = other if out is None else out.unionByName(other)
    if out is None:
        return spark.createDataFrame([], "file_id int, file string, block long, at long, raw string")
    return out


def _read_whole(spark: SparkSession, files: list[File]) -> DataFrame:
    """Files that Spark's readers don't see, each read by one task in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, name, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with store.open_input_stream(where) as source:
                    at, rest = 0, b""
                    while piece := source.read(8 << 20):
                        *lines, rest = (rest + piece).split(b"\n")
                        if lines:
                            yield _piece(file_id, name, at, lines)
                            at += len(lines)
                    if rest:
                        yield _piece(file_id, name, at, [rest])

    def _piece(file_id: int, name: str, at: int, lines: list[bytes]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_pydict({"file_id": pa.array([file_id] * n, pa.int32()), "file": [name] * n, "block": pa.array([0] * n, pa.int64()), "at": pa.array(range(at, at + n), pa.int64()), "raw": pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())})

    listed = spark.createDataFrame([(f.file_id, f.name, f.path) for f in files], "file_id int, file string, path string")
    return listed.repartition(len(files)).mapInArrow(run, "file_id int, file string, block long, at long, raw string")


def placed(raw: DataFrame) -> DataFrame:
    """Lines with line_no (from 1), byte_offset and text (raw without one carriage return at its end).

    A line's place is that of its block, from the sizes of the blocks before, and its own in the block, so no window holds a whole file.
    """
    size = F.octet_length("raw") + 1
    blocks = raw.groupBy("file_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"))
    own = Window.partitionBy("file_id", "block").orderBy("at")
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    joined = raw.join(blocks, ["file_id", "block"])
    text = F.when(F.endswith("raw", F.lit("\r")), F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw"))
    return joined.select("file_id", "file", "block", (F.col("n") + F.row_number().over(own)).alias("line_no"), (F.col("bytes") + F.coalesce(F.sum(size).over(upto), F.lit(0))).alias("byte_offset"), "raw", text.alias("text"))


def lines(spark: SparkSession, files: list[File]) -> DataFrame:
    return placed(raw_lines(spark, files))


def lines_of(df: DataFrame, text: str, file_id: str, file: str, key: str) -> DataFrame:
    """Lines from a column of texts: each text a file of its own, or several in the order of key within a file."""
    split = df.select(F.col(file_id).cast("int").alias("file_id"), F.col(file).cast("string").alias("file"), F.col(key).cast("long").alias("block"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("at", "raw"))
    return placed(split.withColumn("at", F.col("at").cast("long")))
