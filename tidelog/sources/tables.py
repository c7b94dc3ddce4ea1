"""Any table as entries, so that every operator runs on it without a log file in between."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_millis(ts: Column, kind: T.DataType) -> Column:
    """Milliseconds of a time column, cut off, not rounded; a time without zone counts as UTC."""
    if isinstance(kind, T.TimestampNTZType):
        days = F.unix_date(F.to_date(ts)).cast("long")
        # seconds with their fraction, exact in decimals
        return days * 86_400_000 + (F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(ts).cast("long") * 86_400_000
    return F.unix_millis(ts)


def entries_of(df: DataFrame, key: str, ts: str, level: str | None = None, levels: Sequence[str] = (), facets: Mapping[str, str] | None = None, message: str | None = None, text: Column | None = None, file: Column | None = None) -> DataFrame:
    """key, file_id, file, seq, ts_ms, level_ord, level, the facets, message and raw_text, with the table's key as the entry's id.

    levels: ascending; tokens outside it are unknown. facets: name and column. text: what is searched, by default the message.
    """
    scale = F.array(*map(F.lit, levels)) if levels else None
    ordinal = F.coalesce(F.array_position(scale, F.col(level)) - 1, F.lit(-1)) if level and levels else F.lit(-1)
    told = F.col(message).cast("string") if message else F.lit("")
    where = file if file is not None else F.lit("table")
    return df.select(
        F.col(key).alias("entry_id"), where.cast("string").alias("file"), epoch_millis(F.col(ts), df.schema[ts].dataType).alias("ts_ms"), ordinal.cast("tinyint").alias("level_ord"),
        *(F.col(column).cast("string").alias(name) for name, column in (facets or {}).items()), told.alias("message"), (text if text is not None else told).alias("raw_text"),
    )
