"""What the operators of this folder share: tables in the shared folder, skew-proof lookups, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.store import drop, finished, fresh_path, shared_dir, stored

__all__ = ["drop", "finished", "fresh_path", "shared_dir", "stored"]

#: Groups above the share 1 / HOT_SHARE of all rows are hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def kept_table(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with a table of one row for each key; weight is its column that counts the key's rows.

    Keys that hold more than 1 / HOT_SHARE of the total rows are split: their rows are dealt by a hash of all columns over as many parts as keep each within that share, and their row of the table is repeated for each part. Such keys are at most HOT_SHARE in number, and so are what is broadcast; their parts are at most twice as many. No partition gets more than that share from one key, and rows are computed once.
    """
    limit = max(total // HOT_SHARE, 1000)
    parts = F.ceil(F.col(weight) / limit).cast("int")
    hot = table.where(F.col(weight) > limit).select(*keys, parts.alias("_parts"))
    own = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.col("_parts")).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(own, F.lit(0))).drop("_parts")
    spread = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
    return dealt.join(spread.hint("merge"), [*keys, "_part"]).drop("_part")


def row_key(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row, nulls told from values: 128 bits, so that no two different rows share them."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(F.lit(""), *(c.isNull().cast("string") for c in cols))
    return [F.xxhash64(*cols, nulls), F.xxhash64(F.lit(1), nulls, *reversed(cols))]


def stay(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose row_key is in keys (a, b), each key once: rows that repeat are one."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), *(k.alias(n) for k, n in zip(row_key(docs), "ab", strict=True)))
    left = packed.join(keys, ["a", "b"], "left_semi")
    if left.select("a", "b").count() > keys.count():
        left = left.dropDuplicates(["a", "b"])
    return left.select("_all.*")


def words_pattern() -> str:
    """A word: a run of characters that are not ASCII white space (fixed by the contracts)."""
    return r"[^\x20\x09-\x0D]+"


def crc32_mod(col: str | Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")).cast("binary")) % n


def unit(*cols: Column) -> Column:
    """A number in (0, 1) that the columns' hash fixes."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12) + 0.5) / float(1 << 52)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A binary or text column as bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return col.to_pylist()


def slices(values: list[bytes | None] | list[int], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values (or lengths) of about limit bytes each, so that work space does not follow the batch size."""
    start = size = 0
    for i, x in enumerate(values):
        size += x if isinstance(x, int) else len(x or b"")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])
