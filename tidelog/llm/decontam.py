"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

An item gives windows of WINDOW consecutive words. A window that occurs in a document is contained in it whole, so for a containment of 1 the necessary prefix of its shingles, ordered by rarity in the corpus, is the one rarest shingle: only that is joined. A document shingle that equals a window's prefix shingle fixes where the window would have to lie; windows that would stick out of the document (length and position) are put aside, and the rest are verified word by word.

The item side is a table of stated queries. It is cut into blocks of at most BLOCK_WORDS words; each block's index is broadcast, so what is broadcast is bounded by that parameter, and every block passes over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import kept_table, slices, texts_of, with_fields

WINDOW = 10
#: Words of the benchmark whose index is broadcast at once.
BLOCK_WORDS = 300_000
#: Shingle length for rarity and prefixes; shorter windows use their own length.
SHINGLE = 3

#: A word, on the bytes of UTF-8 text in ASCII lower case (fixed by the contract).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Windows:
    """The distinct windows of a block of items, by width."""

    vocabulary: dict[bytes, int]
    width: np.ndarray
    rows: np.ndarray
    #: CSR: the items of each window.
    item_start: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, bytes | None]], size: int = WINDOW) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for n, (_, text) in enumerate(items):
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + size]), set()).add(n)
        rows = np.zeros((len(found), size), np.int64)
        for n, w in enumerate(found):
            rows[n, : len(w)] = w
        counts = [len(x) for x in found.values()]
        return cls(vocabulary, np.array([len(w) for w in found], np.int64), rows, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([i for x in found.values() for i in sorted(x)], np.int64))

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, offset, code) of every shingle of every window."""
        out = []
        for width in np.unique(self.width):
            own = np.flatnonzero(self.width == width)
            k = min(SHINGLE, int(width))
            for at in range(int(width) - k + 1):
                out.append((own, np.full(len(own), at), code(self.rows[own, at : at + k], len(self.vocabulary))))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def code(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """A number for each row of word ids; rows of other widths get other numbers. Vocabularies of up to 2 million words fit in 63 bits."""
    out = np.zeros(len(ids), np.int64)
    for k in range(ids.shape[1]):
        out = out * (vocabulary + 1) + ids[:, k]
    return out


def numbered(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The word ids of all texts in a row, 0 for a word of no item, and where each text starts."""
    lists = [words(x) for x in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    get = vocabulary.get
    return np.fromiter((get(w, 0) for x in lists for w in x), np.int64, int(starts[-1])), starts


def occurrences(ids: np.ndarray, starts: np.ndarray, widths: list[int], wanted: dict[int, np.ndarray], vocabulary: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, index in wanted[k]) of shingles of k item words that are wanted and lie in one text."""
    end = np.repeat(starts[1:], np.diff(starts))
    for k in widths:
        at = np.flatnonzero(ids)
        for j in range(1, k):
            at = at[(at + j < len(ids))]
            at = at[ids[at + j] > 0]
        at = at[at + k <= end[at]]
        codes = code(np.stack([ids[at + j] for j in range(k)], axis=1), vocabulary)
        slot = np.searchsorted(wanted[k], codes)
        slot[slot == len(wanted[k])] = 0
        hit = wanted[k][slot] == codes if len(wanted[k]) else np.zeros(len(codes), bool)
        yield k, at[hit], slot[hit]


def _by_width(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    window, offset, codes = w.shingles()
    return window, offset, codes, np.minimum(w.width, SHINGLE)[window] if len(window) else window


def rarity(docs: DataFrame, text: str, w: Windows) -> dict[tuple[int, int], int]:
    """In how many documents each shingle of a window occurs; counted over all documents, summed by Spark."""
    _, _, codes, ks = _by_width(w)
    wanted = {int(k): np.unique(codes[ks == k]) for k in np.unique(ks)}
    shared = docs.sparkSession.sparkContext.broadcast((w.vocabulary, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, wanted = shared.value
        sums = {k: np.zeros(len(v), np.int64) for k, v in wanted.items()}
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                ids, starts = numbered(texts[a:b], vocabulary)
                for k, at, slot in occurrences(ids, starts, list(wanted), wanted, len(vocabulary)):
                    doc = np.searchsorted(starts, at, side="right")
                    one = np.unique(doc * (len(wanted[k]) + 1) + slot)
                    sums[k] += np.bincount(one % (len(wanted[k]) + 1), minlength=len(wanted[k]))
        for k, v in sums.items():
            seen = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(wanted[k][seen]), pa.array(v[seen])], ["k", "code", "n"])

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n"))
    return {(r["k"], r["code"]): r["n"] for r in counted.collect()}  # at most one row for each shingle of the block's windows


def prefixes(w: Windows, counts: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shingle length: sorted prefix codes, and in CSR form the windows of each and the prefix's offset in them. Windows with a shingle that no document has are left out: they occur nowhere."""
    window, offset, codes, ks = _by_width(w)
    rare = np.array([counts.get((int(k), int(c)), 0) for k, c in zip(ks, codes, strict=True)], np.int64)
    if not len(window):
        return {}
    order = np.lexsort((offset, codes, rare, window))
    first = order[np.concatenate([[True], window[order][1:] != window[order][:-1]])]
    first = first[rare[first] > 0]
    out = {}
    for k in np.unique(ks[first]):
        own = first[ks[first] == k]
        own = own[np.argsort(codes[own], kind="stable")]
        distinct, start = np.unique(codes[own], return_index=True)
        out[int(k)] = (distinct, np.concatenate([start, [len(own)]]), window[own], offset[own])
    return out


def matched(ids: np.ndarray, starts: np.ndarray, w: Windows, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every occurrence of a window in the texts."""
    found_w, found_at = [], []
    wanted = {k: v[0] for k, v in index.items()}
    for k, at, slot in occurrences(ids, starts, list(index), wanted, len(w.vocabulary)):
        _, start, windows, offsets = index[k]
        n = start[slot + 1] - start[slot]
        row = np.repeat(start[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window, begin = windows[row], np.repeat(at, n) - offsets[row]
        doc = np.searchsorted(starts, np.repeat(at, n), side="right") - 1
        fits = (begin >= starts[doc]) & (begin + w.width[window] <= starts[doc + 1])
        window, begin = window[fits], begin[fits]
        for j in range(w.rows.shape[1]):
            ok = (j >= w.width[window]) | (ids[np.minimum(begin + j, len(ids) - 1)] == w.rows[window, j])
            window, begin = window[ok], begin[ok]
        found_w.append(window)
        found_at.append(begin)
    return (np.concatenate(found_w), np.concatenate(found_at)) if found_w else (np.empty(0, np.int64),) * 2


def block_hits(docs: DataFrame, text: str, items: list[tuple[object, bytes | None]], size: int) -> DataFrame:
    """docs with n_words, hits (first and last word of each maximal run of hit words) and found (item numbers as text) for a block of items."""
    w = Windows.of(items, size)
    index = prefixes(w, rarity(docs, text, w))
    shared = docs.sparkSession.sparkContext.broadcast((w, index, [None if i is None else str(i) for i, _ in items]))
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, index, names = shared.value
        for batch in batches:
            texts = texts_of(batch, "_text")
            for a, b in slices(texts):
                ids, starts = numbered(texts[a:b], w.vocabulary)
                window, begin = matched(ids, starts, w, index)
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + w.width[window], -1)
                hit = np.concatenate([np.cumsum(edge[:-1]) > 0, [False]])
                doc = np.searchsorted(starts, begin, side="right") - 1
                runs: list[list[dict]] = [[] for _ in range(b - a)]
                found: list[set] = [set() for _ in range(b - a)]
                for d in np.unique(doc):
                    own = hit[starts[d] : starts[d + 1]].astype(np.int8)
                    step = np.diff(np.concatenate([[0], own, [0]]))
                    runs[d] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(np.flatnonzero(step > 0), np.flatnonzero(step < 0), strict=True)]
                for d, n in zip(doc.tolist(), window.tolist(), strict=True):
                    found[d].update(w.items[w.item_start[n] : w.item_start[n + 1]].tolist())
                cut = batch.slice(a, b - a)
                arrays = [cut.column(i) for i in range(len(keep))]
                arrays += [pa.array(np.diff(starts)), pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([sorted(names[i] for i in x if names[i] is not None) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_words", "hits", "found"])

    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    schema = with_fields(docs.select(*keep), ("n_words", T.LongType()), ("hits", T.ArrayType(span)), ("found", T.ArrayType(T.StringType())))
    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """The items in blocks of at most limit words (one item at least), streamed to the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        n = len(words(bytes(r["t"]))) if r["t"] is not None else 0
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r["i"], None if r["t"] is None else bytes(r["t"])))
        size += n
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hits (runs of hit words, first and last), found (sorted item ids as text) for each row of docs.

    A null or empty text has no words and no hits; an item without words has no window; rows that repeat are answered each; items that share an item_id count as one, a null item_id is never named. An empty benchmark leaves all documents clean, empty documents give no rows. Other columns play no part, whatever their names.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_body"), F.monotonically_increasing_id().alias("_row"))
    all_blocks = blocks(benchmark, item_id, text, block_words)
    first = next(all_blocks, [])
    out, several = block_hits(slim, "_body", first, size), False
    for block in all_blocks:
        out, several = out.unionByName(block_hits(slim, "_body", block, size)), True
    if several:  # the runs of all blocks, merged: sorted by their first word, a run that meets the last one extends it
        out = kept_table(out, "hits").groupBy("doc_id", "_row", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
        last = lambda acc: F.element_at(acc, -1)
        joined = lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["last"] >= x["first"] - 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(x)))
        out = out.withColumn("hits", F.aggregate(F.array_sort("hits"), F.slice("hits", 1, 0), joined))
    return out.select("doc_id", "n_words", "hits", F.array_distinct("found").alias("found"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs. Null and empty texts hold none and stay; items without words have no window; rows that repeat are judged each; columns may have any names; an empty benchmark leaves all."""
    left = docs
    for block in blocks(benchmark, item_id, "text", block_words):
        packed = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_all"), F.col(text).alias("_body"))
        left = block_hits(packed, "_body", block, size).where(F.size("hits") == 0).select("_all.*")
    return left


def digest(marked: DataFrame) -> DataFrame:
    """The counts and the digest that a report needs, from decontaminate()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


