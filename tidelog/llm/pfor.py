"""A file of token ids in patched frame-of-reference blocks.

Layout, little-endian:
  header   8 bytes MAGIC, u32 values in a full block
  blocks   u32 minimum, u8 width, u32 values, u32 exceptions; the values less the minimum, each packed in width bits, the low bits where they don't fit; u32 positions of the exceptions; u32 their high bits
  docs     i64 identifiers; u8 1 where the identifier is null; u32 values of each document
  index    u64 start of each block in the file
  trailer  u64 start of docs, u64 documents, u64 blocks, 8 bytes MAGIC
The width is the smallest that holds PERCENTILE of the block's values, so a few large ids don't widen the others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

MAGIC = b"TIDEPFR1"
BLOCK = 4096
PERCENTILE = 0.9
_HEAD = struct.Struct("<IBII")
_TAIL = struct.Struct("<QQQ8s")


def pack(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block."""
    v = values.astype(np.uint32)
    least = v.min()
    v = v - least
    k = min(len(v) - 1, int(percentile * len(v)))
    width = int(np.partition(v, k)[k]).bit_length()
    over = np.flatnonzero(v >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(v.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    body = np.packbits(bits[:, :width], bitorder="little").tobytes()
    high = (v[over] >> np.uint32(width)).astype("<u4").tobytes() if len(over) else b""
    return _HEAD.pack(int(least), width, len(v), len(over)) + body + over.astype("<u4").tobytes() + high


def unpack(data: bytes, at: int = 0) -> np.ndarray:
    """The values of the block that starts there."""
    least, width, n, n_over = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = -(-n * width // 8)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
    v = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    at += size
    if n_over:
        where = np.frombuffer(data, "<u4", n_over, at)
        v[where] |= np.frombuffer(data, "<u4", n_over, at + 4 * n_over).astype(np.uint32) << np.uint32(width)
    return v + np.uint32(least)


class Writer:
    """Appends documents; holds one open block and a few numbers for each document."""

    def __init__(self, out: BinaryIO, block: int = BLOCK, percentile: float = PERCENTILE) -> None:
        self.out, self.block, self.percentile = out, block, percentile
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.starts: list[int] = []
        self.at = out.write(MAGIC + struct.pack("<I", block))

    def add(self, doc_id: int | None, values: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(values))
        self.held.append(values)
        self.waiting += len(values)
        self.total += len(values)
        if self.waiting >= 64 * self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        values = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(values) - len(values) % least if least > 1 else len(values)
        for k in range(0, end, self.block):
            self.starts.append(self.at)
            self.at += self.out.write(pack(values[k : min(k + self.block, end)], self.percentile))
        self.held, self.waiting = [values[end:]], len(values) - end

    def close(self) -> None:
        self._flush(1)
        docs = np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], np.uint8).tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(docs + np.array(self.starts, "<u8").tobytes() + _TAIL.pack(self.at, len(self.ids), len(self.starts), MAGIC))


def read(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(identifier, values) of each document in file order; source can seek. Holds one block and one document."""
    source.seek(0, 2)
    size = source.tell()
    source.seek(size - _TAIL.size)
    docs_at, n_docs, n_blocks, magic = _TAIL.unpack(source.read(_TAIL.size))
    if magic != MAGIC:
        raise ValueError("not a file of packed token ids")
    source.seek(docs_at)
    table = source.read(size - _TAIL.size - docs_at)
    ids = np.frombuffer(table, "<i8", n_docs)
    none = np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(table, "<u4", n_docs, 9 * n_docs)
    starts = [*np.frombuffer(table, "<u8", n_blocks, 13 * n_docs).tolist(), docs_at]
    held, have, k = [], 0, 0
    for doc_id, is_none, n in zip(ids.tolist(), none.tolist(), counts.tolist(), strict=True):
        while have < n:
            source.seek(starts[k])
            held.append(unpack(source.read(starts[k + 1] - starts[k])))
            have, k = have + len(held[-1]), k + 1
        values = np.concatenate(held) if held else np.empty(0, np.uint32)
        yield (None if is_none else doc_id), values[:n]
        held, have = [values[n:]], have - n


def block(source, k: int) -> np.ndarray:
    """The values of block k alone, found by the index of block starts."""
    source.seek(0, 2)
    size = source.tell()
    source.seek(size - _TAIL.size)
    docs_at, n_docs, n_blocks, _ = _TAIL.unpack(source.read(_TAIL.size))
    source.seek(docs_at + 13 * n_docs)
    starts = [*np.frombuffer(source.read(8 * n_blocks), "<u8").tolist(), docs_at]
    source.seek(starts[k])
    return unpack(source.read(starts[k + 1] - starts[k]))
