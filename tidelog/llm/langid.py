"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the n-grams of all languages at once: each of its SLICES tables has a bit mask of languages in every slot, and the AND of an n-gram's slots gives all languages that contain it. For each language the n-grams of a text that carry its bit are counted, the count is corrected for the filter's false positives, and the largest one decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import crc32_mod, slices, texts_of, unit, with_fields

#: Bytes of an n-gram; labelled rows of each language that are learnt from, about so many at most, by hash; the share of a language's rows that must hold an n-gram (wrong labels stay below it).
GRAM, SAMPLE, LEAST = 4, 1500, 0.006
#: Slots of a table, as a power of two, and tables.
SLOTS, SLICES = 20, 2
UNKNOWN = "und"
#: Languages of a mask word; a slot has as many words as all languages need.
WORD = 64

#: ASCII letters stay, other ASCII becomes a space, bytes of other characters stay.
_FOLD = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def folded(text: bytes) -> bytes:
    """Lower case, with one space before, between and after the words."""
    return b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split()) + b" "


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def grams(text: bytes, n: int = GRAM) -> np.ndarray:
    """Every run of n bytes of a folded text, as a number."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(x) < n:
        return np.empty(0, np.uint64)
    out = x[: len(x) - n + 1].copy()
    for k in range(1, n):
        out = (out << np.uint64(8)) | x[k : len(x) - n + 1 + k]
    return out


def slots(values: np.ndarray, bits: int = SLOTS, tables: int = SLICES) -> list[np.ndarray]:
    """The slot of each n-gram in each table."""
    return [((values + np.uint64(k + 1)) * np.uint64(m) >> np.uint64(64 - bits)).astype(np.int64) for k, m in enumerate(_MULTIPLIERS[:tables])]


@dataclass
class Filter:
    """names by bit; masks[k] has the languages of each slot of table k, a row for each WORD of them; false positives of a language's bit, from how full its slots are."""

    names: list[str]
    masks: list[np.ndarray]
    false: np.ndarray

    @classmethod
    def of(cls, names: list[str], values: np.ndarray, languages: np.ndarray, bits: int = SLOTS, tables: int = SLICES) -> Filter:
        """From pairs of an n-gram and a language that contains it."""
        masks = [np.zeros((max(1, -(-len(names) // WORD)), 1 << bits), np.uint64) for _ in range(tables)]
        bit = np.uint64(1) << (languages % WORD).astype(np.uint64)
        for mask, at in zip(masks, slots(values, bits, tables), strict=True):
            np.bitwise_or.at(mask, (languages // WORD, at), bit)
        full = [[float(np.mean(mask[k // WORD] >> np.uint64(k % WORD) & np.uint64(1))) for k in range(len(names))] for mask in masks]
        return cls(names, masks, np.prod(full, axis=0) if names else np.empty(0))

    def masks_of(self, values: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages of a word that contain each n-gram; more by false positives, never fewer."""
        found = None
        for mask, at in zip(self.masks, slots(values, self.masks[0].shape[1].bit_length() - 1, len(self.masks)), strict=True):
            found = mask[word, at] if found is None else found & mask[word, at]
        return found

    def counts(self, text: bytes) -> tuple[np.ndarray, int]:
        """The corrected count of each language, and the number of n-grams."""
        values = grams(folded(text))
        raw = np.zeros(len(self.names), np.float64)
        for first in range(0, len(self.names) if len(values) else 0, WORD):
            masks, times = np.unique(self.masks_of(values, first // WORD), return_counts=True)
            for k in range(first, min(first + WORD, len(self.names))):
                raw[k] = times[(masks >> np.uint64(k - first) & np.uint64(1)) > 0].sum()
        return np.maximum(0, (raw - len(values) * self.false) / np.maximum(1e-9, 1 - self.false)), len(values)

    def predict(self, text: bytes | None) -> tuple[str, float, float]:
        """Language, its share of all corrected counts, and the share of n-grams that it explains."""
        if not text or not self.names or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        counts, n = self.counts(text)
        best = int(np.argmax(counts))
        total = float(counts.sum())
        return self.names[best], float(counts[best] / total) if total else 0.0, float(min(1.0, counts[best] / n)) if n else 1.0


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, least: float = LEAST) -> Filter:
    """A filter from the rows of docs with a text and a language: of each language the rows whose hash lies in the share that makes about sample rows.

    The rows are a bounded sample, so are their n-grams, which the driver gathers where enough rows hold them. Null texts and languages teach nothing, empty texts have no n-gram, rows that repeat teach each; without rows no language is known.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), unit(F.col(doc_id).cast("string"), F.col(text)).alias("_u"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    names = list(sizes)  # on a tie the more frequent one decides
    if not names:
        return Filter([], [np.zeros((1, 1 << SLOTS), np.uint64) for _ in range(SLICES)], np.empty(0))
    share = F.element_at(F.create_map(*(F.lit(v) for x in names for v in (x, sample / sizes[x]))), F.col("lang"))
    chosen = known.where(F.col("_u") < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), texts_of(batch, "text")
            for a, b in slices(texts):
                own = [np.unique(grams(folded(x))) for x in texts[a:b]]
                code = np.repeat([names.index(x) for x in langs[a:b]], [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(np.concatenate(own).astype(np.int64))], ["lang", "gram"])

    found = chosen.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang int, gram long").groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    enough = F.element_at(F.array(*(F.lit(max(1.0, least * min(sample, sizes[x]))) for x in names)), F.col("lang") + 1)
    table = found.where(F.col("n") >= enough).select("lang", "gram").toArrow()
    return Filter.of(names, table["gram"].to_numpy().astype(np.uint64), table["lang"].to_numpy().astype(np.int64))


def identify(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """The other columns of docs (none of them may be named so) with lang_pred, score and known for each row.

    lang_pred is a learnt language, or und where the text is null or has no letter; score is the share of the language in the corrected counts of all; known is the share of the text's n-grams that the language contains, 1 for a text too short for any. A text whose n-grams no language contains gets the most frequent language with score 0. Rows that repeat are judged each; no column but the text plays a part. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = texts_of(batch, "_text")
            for a, b in slices(texts):
                found = [model.predict(x) for x in texts[a:b]]
                cut = batch.slice(a, b - a)
                arrays = [cut.column(i) for i in range(len(keep))] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score", "known"])

    schema = with_fields(docs.select(*keep), ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("known", T.DoubleType()))
    return docs.select(*keep, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The contract's fold: rows that nothing is learnt from."""
    return crc32_mod(doc_id, 4) == 2


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and known: learnt from the rows outside the fold, told for all. Nulls, empty texts, ties and repeats as in identify()."""
    model = train(docs.where(~held_out(doc_id)), doc_id, text, lang)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_body"))
    return identify(slim, model, "_body").select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "known")


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least_known: float = 0.2) -> DataFrame:
    """The rows of docs that are in some learnt language: not und, and with least_known of the n-grams in it. Null and empty texts go, rows that repeat are judged each, columns may have any names; without labelled rows all stay; an empty table gives no rows."""
    model = train(docs.where(~held_out(doc_id)), doc_id, text, lang)
    if not model.names:  # nothing is known of any language, so nothing can be rejected for it
        return docs
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), F.col(text).alias("_body"))
    told = identify(packed, model, "_body")
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= least_known)).select("_all.*")
