"""Suffix-array dedup: removes every byte of a string of LENGTH bytes that starts in more than one place.

A corpus is too large for one suffix array, so it is cut into shards in which every repeat is whole. Each window of LENGTH bytes has an anchor, the GRAM-byte string in it with the smallest hash; equal windows have equal anchors at equal places. The consecutive windows of a text with one anchor make a context, the bytes that these windows cover. Contexts with the same anchor form a shard; most anchors occur once, and their contexts have no repeat. Contexts that are equal as a whole repeat as a whole. Where an anchor has different contexts, one of each goes to a suffix array, built by induced sorting; positions whose permuted common prefix with a neighbour reaches LENGTH start a repeated window.

A shard of more than WIDE contexts, as a passage that many texts share makes, is too large for one suffix array. Its windows are cut into sub-shards by a second anchor: windows in which the anchor begins in the same range of `width` bytes share a core, the LENGTH - width + 1 bytes around the anchor that all of them cover, so equal windows have equal cores, and contexts with the same core form a sub-shard. What is still too wide is cut again with the next of WIDTHS; a width of 1 makes the core the window itself, so every sub-shard is small in the end, and each is settled as a shard is.

Texts are known by a 64-bit hash that is checked against their SHA-256 digest, and drawn anew with another seed if two texts share one. Contexts are known by 128 bits within a shard; a shard's own key only gathers, so that a clash there costs time and no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import kept_table, lookup, texts_of
from tidelog.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, GRAM = 200, 72
#: Contexts of a shard that share a suffix array, at most; bytes of small shards that share one.
WIDE, SHARED_BYTES = 1_000, 30_000
#: Ranges of the anchor's place that make sub-shards, one after the other.
WIDTHS = (16, 4, 1)
#: Windows of a text that are worked on at once.
CHUNK = 1 << 17

_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER = _powers(_ODD, CHUNK + LENGTH + 1)
_INVERSE = _powers(pow(_ODD, -1, 1 << 64), CHUNK + LENGTH + 1)


def _anchors_of(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of the anchor, first and last window of each context; data has length bytes at least."""
    n, width = len(data), length - gram + 1
    m = n - gram + 1
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + _U(1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * _POWER[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * _INVERSE[:m]
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    key = (h & _U(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)  # the leftmost of equal ones
    rows = -(-m // width)
    padded = np.full(rows * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[:m] = key
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - width + 1], ahead[width - 1 : m])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    at = (least[first] & _U(0xFFFFFF)).astype(np.int64)
    return h[at], at, first, last


def contexts(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of each context of a text; every window is in one."""
    parts = []
    for at in range(0, len(data) - length + 1, CHUNK):
        anchor, _, first, last = _anchors_of(data[at : at + CHUNK + length - 1], length, gram)
        parts.append((anchor, first + at, last + at))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, for each of its windows, whether the window's bytes start anywhere else in the pieces."""
    data = b"\xff".join(pieces)  # no UTF-8 text has this byte
    order = suffix_array(np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1, [0]]))
    size = np.array([len(p) for p in pieces])
    windows = size - length + 1
    begin = np.cumsum(size + 1) - size - 1
    starts = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())  # of whole windows
    previous, shared = permuted_prefixes(data, order, starts)
    hit = np.zeros(len(data), bool)
    long_ = shared >= length
    hit[starts[long_]] = True
    hit[previous[long_]] = True
    return [hit[b : b + w] for b, w in zip(begin.tolist(), windows.tolist(), strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step > 0), np.flatnonzero(step < 0) - 1


def _digests(pieces: list[bytes]) -> np.ndarray:
    """The two halves of a digest of each piece."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<i8").reshape(-1, 2)


def _batches_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _scan(texts: DataFrame, schema: str, with_contexts: bool, length: int, gram: int) -> DataFrame:
    """anchor of each context of each row (tid, text); with contexts also ctx and sure (the halves of a digest), tid and place (first window, and windows - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, all_texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch, "text")
            out, size = [], 0

            def flush() -> pa.RecordBatch:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "ctx", "sure", "tid", "place"][: len(cols)])

            for tid, text in zip(tids, all_texts, strict=True):
                if len(text) < length:
                    continue
                anchor, first, last = contexts(text, length, gram)
                if with_contexts:
                    halves = _digests([text[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                    out.append((anchor.view(np.int64), halves[:, 0], halves[:, 1], np.full(len(first), tid, np.int64), first << 10 | (last - first)))
                else:
                    out.append((anchor.view(np.int64),))
                size += len(anchor)
                if size > 200_000:
                    yield flush()
                    out, size = [], 0
            if out:
                yield flush()

    return texts.select("tid", "text").mapInArrow(run, schema)


#: Contexts with their bytes, as suffix arrays and sub-shards take them: many says that a context is settled already, and only a partner for others.
_PIECE = "anchor long, ctx long, sure long, tid long, place long, many boolean, text binary"
_PIECE_KINDS = [*[pa.int64()] * 5, pa.bool_(), pa.binary()]
_PIECE_NAMES = ["anchor", "ctx", "sure", "tid", "place", "many", "text"]


def _sorted_shards(length: int):
    """Rows of _PIECE sorted by anchor: repeated windows of the contexts that are not settled, as (tid, first, last)."""

    def work(shards: list[tuple]) -> list[tuple]:
        out = []
        for (tid, place, many), flags in zip([x[:3] for x in shards], repeated_windows([x[3] for x in shards], length), strict=True):
            if not many:
                at = place >> 10
                out += [(tid, at + int(a), at + int(b)) for a, b in zip(*runs(flags), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["tid", "first", "last"], [pa.int64()] * 3
        held: list[tuple] = []
        size, anchor = 0, None
        for batch in batches:
            anchors, tids, places, many, data = (batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6))
            for a, tid, place, m, text in zip(anchors, tids, places, many, data, strict=True):
                if a != anchor and size >= SHARED_BYTES:
                    if found := work(held):
                        yield _batches_of(found, names, kinds)
                    held, size = [], 0
                anchor = a
                held.append((tid, place, m, text))
                size += len(text)
        if held and (found := work(held)):
            yield _batches_of(found, names, kinds)

    return run


def cores(text: bytes, width: int, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[bytes, int, int]]:
    """The core of each sub-shard that windows of a context belong to, and the first and last of these windows; text is the context's bytes."""
    _, (at, *_), _, _ = _anchors_of(text, length, gram)  # all windows have one anchor
    at, windows = int(at), len(text) - length + 1
    for begin in range(0, length - gram + 1, width):  # the anchor's place in a window, from the window's first byte
        last = min(begin + width, length - gram + 1) - 1
        low, high = max(0, at - last), min(windows - 1, at - begin)
        if low <= high:
            yield begin.to_bytes(2, "little") + text[at - begin : at - last + length], low, high


def _cores(width: int, length: int, gram: int):
    """Rows of _PIECE, whole contexts, to rows of their parts in sub-shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, parts, keys = [], [], []
            for tid, place, many, text in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True):
                for core, low, high in cores(text, width, length, gram):
                    keys.append(core)
                    parts.append(text[low : high + length])
                    out.append((tid, ((place >> 10) + low) << 10 | (high - low), many))
            if out:
                tids, places, many = zip(*out, strict=True)
                halves = _digests(parts)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((_digests(keys)[:, 0], halves[:, 0], halves[:, 1], tids, places, many, parts), _PIECE_KINDS, strict=True)], _PIECE_NAMES)

    return run


def _sub_shards(pieces: DataFrame, total: int, length: int, gram: int, wide: int) -> DataFrame:
    """Repeated windows (tid, first, last) of contexts in shards that are too wide."""
    out = None
    begin = F.shiftright("place", 10)
    for width in WIDTHS:
        parts = kept_table(pieces.mapInArrow(_cores(width, length, gram), _PIECE), "parts")
        count = F.count(F.lit(1))
        same = kept_table(parts.groupBy("anchor", "ctx", "sure").agg(count.alias("n"), F.max("many").alias("many"), *(F.first(c).alias(c) for c in ("tid", "place", "text"))), "distinct")
        settled = (F.col("n") > 1) | F.col("many")
        again = lookup(parts.where("NOT many").select("anchor", "ctx", "sure", "tid", "place"), same.where(settled).select("anchor", "ctx", "sure", "n"), ["anchor", "ctx", "sure"], "n", total)
        found = again.select("tid", begin.alias("first"), (begin + F.col("place").bitwiseAND(1023)).alias("last"))
        shards = kept_table(same.groupBy("anchor").agg(count.alias("different"), F.min(settled).alias("settled")).where("different > 1 AND NOT settled").select("anchor", (F.col("different") > wide).alias("wide")), "shards")
        need = same.join(shards, "anchor").select("anchor", "ctx", "sure", "tid", "place", settled.alias("many"), "text", "wide")
        narrow = need.where("NOT wide").drop("wide").repartition("anchor").sortWithinPartitions("anchor", "ctx", "sure")
        found = found.unionByName(narrow.mapInArrow(_sorted_shards(length), "tid long, first long, last long"))
        out = found if out is None else out.unionByName(found)
        if shards.where("wide").isEmpty():
            return out
        pieces = kept_table(need.where("wide").drop("wide"), "pieces")
    # cores of width 1 are whole windows, so a key that still has many of them is a clash of hashes: its array is long, and right
    last = pieces.repartition("anchor").sortWithinPartitions("anchor", "ctx", "sure")
    return out.unionByName(last.mapInArrow(_sorted_shards(length), "tid long, first long, last long"))


def repeats(texts: DataFrame, copies: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """Repeated windows (tid, first, last), and the rows (row, tid, text) of distinct texts that may hold some.

    texts has row, tid and text; copies has for each tid its number of rows, and the one that stands for them.
    """
    total = F.count(F.lit(1))
    often = kept_table(_scan(texts, "anchor long", False, length, gram).groupBy("anchor").agg(total.alias("n")).where("n > 1"), "anchors")
    n = often.agg(F.sum("n")).first()[0] or 0
    key = ["anchor", "ctx", "sure"]
    rows = lookup(_scan(texts, "anchor long, ctx long, sure long, tid long, place long", True, length, gram), often, ["anchor"], "n", n).select(*key, "tid", "place").distinct()
    rows = kept_table(rows, "contexts")
    same = kept_table(rows.groupBy(*key).agg(total.alias("n"), F.min(F.struct("tid", "place")).alias("one")), "distinct")
    shards = same.groupBy("anchor").agg(total.alias("different"), F.min("n").alias("least")).where("different > 1 AND least = 1")
    once = same.where("n > 1")
    whole = kept_table(lookup(rows, once, key, "n", n).select("tid", F.shiftright("place", 10).alias("first"), (F.shiftright("place", 10) + F.col("place").bitwiseAND(1023)).alias("last")), "whole")
    need = same.join(shards, "anchor").select(*key, F.col("one.tid").alias("tid"), F.col("one.place").alias("place"), (F.col("n") > 1).alias("many"), (F.col("different") > wide).alias("wide"))
    per_text = need.groupBy("tid").agg(F.collect_list(F.struct(*key, "place", "many", "wide")).alias("need"))
    touched = whole.join(copies.where("copies = 1"), "tid", "left_semi").select("tid").union(need.select("tid")).distinct()
    marked = touched.join(per_text, "tid", "left").join(copies.select("tid", "row"), "tid").select("row", "need")
    held = kept_table(texts.join(marked, "row"), "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [*_PIECE_NAMES, "wide"], [*_PIECE_KINDS, pa.bool_()]
        for batch in batches:
            out = []
            for tid, text, need in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                for x in need:
                    at = x["place"] >> 10
                    out.append((x["anchor"], x["ctx"], x["sure"], tid, x["place"], x["many"], text[at : at + (x["place"] & 1023) + length], x["wide"]))
                if len(out) > 20_000:
                    yield _batches_of(out, names, kinds)
                    out = []
            if out:
                yield _batches_of(out, names, kinds)

    pieces = kept_table(held.where("need IS NOT NULL").select("tid", "text", "need").mapInArrow(cut, _PIECE + ", wide boolean"), "pieces")
    narrow = pieces.where("NOT wide").drop("wide").repartition("anchor").sortWithinPartitions(*key)
    found = whole.unionByName(narrow.mapInArrow(_sorted_shards(length), "tid long, first long, last long"))
    large = pieces.where("wide").drop("wide")
    if not large.isEmpty():
        found = found.unionByName(_sub_shards(large, n, length, gram, wide))
    return found, held.select("row", "tid", "text")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs: first byte and the one after the last) and kept_sha256 for each row of docs.

    Texts are taken as UTF-8 bytes; null is empty. Texts of fewer than length bytes keep all. Rows that repeat are copies of each other, whatever their doc_id, and lose all bytes if they have length bytes. No match crosses rows. Other columns of docs play no part, whatever their names. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    seed = -1
    while True:
        seed += 1
        texts = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).withColumn("tid", F.xxhash64(F.lit(seed), "text"))
        keyed = texts.withColumn("row", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("doc_id").isNull(), F.col("tid")))
        rows = kept_table(keyed.select("doc_id", "row", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "digests")
        copies = kept_table(rows.groupBy("tid", "sha").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "copies")
        clash = copies.groupBy("tid").count().where("count > 1").select("tid")
        same_row = rows.groupBy("row").agg(F.min(F.struct("doc_id", "tid")).alias("a"), F.max(F.struct("doc_id", "tid")).alias("b")).where("a != b").select("row")
        if clash.union(same_row).isEmpty():
            break
    found, held = repeats(keyed.select("row", "tid", "text"), copies, length, gram, wide)
    per_text = kept_table(found.groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("found")), "found")
    single = per_text.join(copies.where("copies = 1").select("tid", "row"), "tid").select("row", "found")
    partial = held.drop("tid").join(single, "row").mapInArrow(_cut(length), "row long, spans array<struct<first:bigint,after:bigint>>, kept_sha256 string")
    total = rows.count()
    marks = lookup(rows, copies.select("tid", "sha", "copies"), ["tid", "sha"], "copies", total)
    partial = kept_table(partial, "removed").dropDuplicates(["row"])
    joined = marks.join(partial, "row", "left")
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("after"))), 1, 0)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("after")))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return joined.select("doc_id", "n_bytes", F.when(gone, all_).otherwise(F.coalesce("spans", none)).alias("spans"), F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def _cut(length: int):
    """Rows (row, text, found): the removed runs and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, digests = batch.column(0), [], []
            for text, found in zip(texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for first, last in sorted((x["first"], x["last"]) for x in found):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last + length)
                    else:
                        merged.append([first, last + length])
                left, at = hashlib.sha256(), 0
                for first, after in merged:
                    left.update(text[at:first])
                    at = after
                left.update(text[at:])
                digests.append(left.hexdigest())
                spans.append([{"first": a, "after": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([rows, pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), pa.array(digests, pa.string())], ["row", "spans", "kept_sha256"])

    return run


def digest(removed: DataFrame) -> DataFrame:
    """The counts that a report needs, from remove_repeats()."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["after"] - x["first"])
    return removed.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
