"""Token-ID output: texts to ids, ids to files of patched frame-of-reference blocks, files back to rows.

The ids are dealt by ranges of doc_id, whose bounds come from quantiles of doc_id alone, so texts are tokenized once. There are as many ranges as the bytes of text fill files of FILE_BYTES, and as many as Spark deals shuffles into at least; a doc_id with so many rows that several bounds fall on it is dealt among their ranges by a checksum of the ids. Each range becomes a file under a name of its own, which counts only if the task's row in the manifest does; a task that runs again writes another. The manifest stands beside the files and tells where each file starts, so a folder can be read by itself.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import fresh_path, kept_table, slices

END_ID = 1
#: Where a null doc_id stands: first.
LEAST_ID = -(1 << 63)
#: Words and other parts whose ids a worker remembers in each of two generations; when one is full, the older goes.
REMEMBERED = 300_000
#: Bytes of text that are encoded at once, and bytes of text of a file, about.
AT_ONCE, FILE_BYTES = 2_500_000, 256 << 20
#: Name of the manifest in the folder.
MANIFEST = "manifest"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Punctuation that may end a piece; the tokenizer splits it from the letters before it.
TAIL = ".,;:!?|*#$%&-\"()"


def plain_words(tokenizer):
    """A tokenizer of the same model that takes lower-case ASCII words between spaces, or None.

    Normalization and splitting don't change such words where they only compose characters, fold white space and case, and split letters from the rest; then they need not run.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    whole = json.loads(tokenizer.to_str())
    normalizers = (whole["normalizer"] or {}).get("normalizers", [])
    splits = (whole["pre_tokenizer"] or {}).get("pretokenizers", [])
    folds = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"}) for x in normalizers) and any(x["type"] == "Lowercase" for x in normalizers)
    letters = len(splits) == 2 and splits[0]["type"] == "Split" and r"[\p{L}]+" in splits[0]["pattern"].get("Regex", "").split("|") and splits[0]["invert"] and splits[1]["type"] == "ByteLevel" and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
    if not (folds and letters):
        return None
    out = Tokenizer(tokenizer.model)
    out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return out


class Encoder:
    """Ids of texts by a tokenizer that splits words from punctuation and drops the white space between them.

    Such a tokenizer gives a text the ids of its pieces between ASCII white space, one after the other. A piece of letters, or of letters with punctuation after them, is a word and a tail to it. Arrow cuts a batch into pieces, words and tails and numbers the distinct ones; only those not yet remembered are encoded, and numpy lays the ids out in text order. New words are encoded many at a time: each is one word to the tokenizer, so its last id is one that ends a word. Where the ends don't number as many as the words, and for all other parts, each is encoded on its own.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain_words(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _alone(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _together(self, tokenizer, words: list[str]) -> list[bytes]:
        chunks = [" ".join(words[k : k + 2000]) for k in range(0, len(words), 2000)]
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        ids = np.concatenate([np.empty(0, self.kind), *(np.array(e.ids, self.kind) for e in encode(chunks, add_special_tokens=False))])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._alone(words)
        data, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
        at = [0, *(ends * size).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, parts: list[str]) -> None:
        words = [p for p in parts if p.isalpha() and p == p.lower()]
        plain = [p for p in words if p.isascii()]
        other = [p for p in words if not p.isascii()]
        rest = list({*parts}.difference(words))
        self.known.update(zip(plain, self._together(self.plain or self.tokenizer, plain), strict=True))
        self.known.update(zip(other, self._together(self.tokenizer, other), strict=True))
        self.known.update(zip(rest, self._alone(rest), strict=True))

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each of the distinct parts."""
        if len(self.known) + len(parts) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = {*parts} - self.known.keys()
        if old := new & self.older.keys():
            self.known.update((p, self.older[p]) for p in old)
            new -= old
        if new:
            self._learn(list(new))
        return [*map(self.known.__getitem__, parts)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text and the end id, as bytes of self.kind; texts is binary, null is empty."""
        try:
            texts = texts.fill_null(b"").cast(pa.string())
        except pa.ArrowInvalid:  # not all of it is UTF-8
            texts = pa.array([(x or b"").decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
        lists = pc.ascii_split_whitespace(texts)
        numbered = lists.flatten().dictionary_encode()
        pieces = numbered.dictionary
        stems = pc.ascii_rtrim(pieces, characters=TAIL)
        letters = pc.and_not(pc.utf8_is_alpha(stems), pc.match_substring(stems, "\u0130"))  # its lower case ends in a mark
        size = np.where(letters.to_numpy(zero_copy_only=False), pc.binary_length(stems).to_numpy(zero_copy_only=False), pc.binary_length(pieces).to_numpy(zero_copy_only=False))
        # every piece as two parts, a word and its tail, or the piece and nothing
        begin = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset)
        cuts = np.empty(2 * len(pieces) + 1, np.int32)
        cuts[0::2] = begin
        cuts[1::2] = begin[:-1] + size
        parts = pa.Array.from_buffers(pa.string(), 2 * len(pieces), [None, pa.py_buffer(cuts), pieces.buffers()[2]])
        word = np.zeros(2 * len(pieces), bool)
        word[0::2] = letters.to_numpy(zero_copy_only=False)
        parts = pc.if_else(pa.array(word), pc.ascii_lower(parts), parts).dictionary_encode()
        found = self._ids_of(parts.dictionary.to_pylist())
        width = self.kind.itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        length = np.fromiter(map(len, found), np.int64, len(found)) // width
        part = parts.indices.to_numpy(zero_copy_only=False)
        flat, length = _laid_out(flat, length, part), length[part]
        length = length[0::2] + length[1::2]
        piece = numbered.indices.to_numpy(zero_copy_only=False)
        ids, length = _laid_out(flat, length, piece), length[piece]
        upto = np.concatenate([[0], np.cumsum(length)])
        after = upto[lists.offsets.to_numpy()]
        ids = np.insert(ids, after[1:], self.kind.type(END_ID))
        offsets = ((after + np.arange(len(after))) * width).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(self.kind.newbyteorder("<")))])


def _laid_out(flat: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """flat holds sequences of the given lengths one after the other; gives them in that order."""
    start = np.cumsum(length) - length
    n = length[order]
    shift = np.repeat(start[order] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(len(shift))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, path: str, bounds: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, doc_id, ids): the number of the range of doc_id, and the ids of each row's whole text and the end id, packed as little-endian integers of two or four bytes."""
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), AT_ONCE):
                ids = batch.column(0).slice(a, b - a)
                number = ids.fill_null(LEAST_ID).to_numpy(zero_copy_only=False)
                place, encoded = np.searchsorted(edges, number), enc.encode(texts.slice(a, b - a))
                several = np.searchsorted(edges, number, side="right") - place
                for k in np.flatnonzero(several > 1).tolist():
                    place[k] += zlib.crc32(encoded[k].as_buffer()) * int(several[k]) >> 32
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), ids, encoded], ["range", "doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "range int, doc_id long, ids binary")


def write_files(ids: DataFrame, folder: str, width: int, files: int) -> DataFrame:
    """Writes the files, ascending in doc_id (null first), and returns the manifest: file, name, n_docs, n_ids, start."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tidelog.llm.pfor import Writer

        store, base = fs.FileSystem.from_uri(folder)
        name, writer, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pfr", None, None
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                    writer = Writer(out)
                writer.add(doc_id, np.frombuffer(data, kind))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n_docs": [len(writer.ids)], "n_ids": [writer.total]})

    dealt = ids.repartitionById(files, F.col("range")).select("doc_id", "ids").sortWithinPartitions("doc_id", F.crc32("ids"), "ids")
    manifest = kept_table(dealt.mapInArrow(run, "file int, name string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    whole = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    whole.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    return ids.sparkSession.read.schema(whole.schema).parquet(f"{folder}/{MANIFEST}")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files that the folder's manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.llm.pfor import read

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with store.open_input_file(f"{base}/{name}") as source:
                    for doc_id, values in read(source):
                        rows.append((doc_id, start, len(values), zlib.crc32(values.astype("<u4").tobytes())))
                        start += len(values)
                        if len(rows) >= 50_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(f"{folder}/{MANIFEST}").select("name", "start")
    return files.repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ranges(docs: DataFrame, doc_id: str, text: str, files: int | None) -> list[int]:
    """The last doc_id of each range but the last, for so many files, or as many as the bytes of text fill."""
    spark = docs.sparkSession
    if files is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    at = [k / files for k in range(1, files)]
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_ID))
    return docs.select(F.percentile_approx(number, F.array(*map(F.lit, at)), min(100 * files, 1_000_000))).first()[0] or [] if at else []


def token_output(spark: SparkSession, docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, files: int | None = None) -> tuple[DataFrame, str]:
    """Writes the ids of all documents to files and returns what is read back from them, and the folder, which stays.

    A null or empty text gives the end id alone. Rows that repeat are written each; rows that tie on doc_id follow one another, in an order that their ids fix; a null doc_id comes first. An empty table writes no file and gives no rows. doc_id is an integer; other columns play no part, whatever their names.
    """
    folder = folder or fresh_path(spark, "tokens", lasting=True)
    bounds = ranges(docs, doc_id, text, files)
    ids = tokenize(docs, path, bounds, doc_id, text)
    write_files(ids, folder, encoder(path).kind.itemsize, len(bounds) + 1)
    return read_files(spark, folder), folder
