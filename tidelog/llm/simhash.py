"""SimHash near-dedup: fingerprints, and a grid range join of their segment popcounts.

A fingerprint maps to the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors is at most the Hamming distance of the fingerprints, so linked ones lie within 3 of each other. The segments form GROUPS groups; a distance of 3 can touch 3 groups at most, so linked fingerprints have equal counts in some GROUPS - 3 of them. Each choice of groups is a grid of unit cells in that subspace: fingerprints that share a cell are candidates, a range join on the total count and the Manhattan distance over byte segments thin them, and the exact distance decides. No link is lost, whatever the size of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import drop, finished, kept_table, lookup, row_key, stay, stored, texts_of, unit, with_fields
from tidelog.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Groups of segments, at least and at most; 5 give 10 grids with cells of 26 bits' counts.
GROUPS, MOST_GROUPS = 5, 12
#: What a pair that is compared costs against a row of a grid that is dealt.
PAIR_COST = 0.1
#: Members of a block; a cell with more is compared block against block, each pair of blocks on its own.
BLOCK = 4096
#: Pairs that are compared at once.
PAIRS = 250_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of a text, repeats included: ASCII lower case, words split at ASCII white space, joined by a space."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *(ends[: len(words) - size]).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def simhash(hashes: list[int]) -> int:
    """A bit is 1 if set in over half the hashes; without hashes all are 0."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(h[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The other columns of docs and fp, the fingerprint's 64 bits as a long, for each row; null and empty texts have 0."""
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                cut = batch.slice(start, 1000)
                fp = np.array([simhash(shingle_hashes(x or b"", shingle)) for x in texts_of(cut, "_text")], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], pa.array(fp)], [*others, "fp"])

    rows = docs.select(*others, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, with_fields(docs.select(*others), ("fp", T.LongType())))


def cell_keys(fp: np.ndarray, groups: int = GROUPS, distance: int = DISTANCE) -> list[np.ndarray]:
    """For each choice of groups - distance groups, the cell of each fingerprint: a hash of the choice and the counts in it."""
    low = fp & np.uint64(0x5555555555555555)
    high = (fp >> np.uint64(1)) & np.uint64(0x5555555555555555)
    counts = low + high  # 32 fields of two bits, each the popcount of its segment
    ends = [round(32 * k / groups) for k in range(groups + 1)]
    masks = [np.uint64(((1 << (2 * (b - a))) - 1) << (2 * a)) for a, b in zip(ends, ends[1:], strict=False)]
    keys = []
    for n, chosen in enumerate(combinations(masks, groups - distance)):
        x = (counts & np.bitwise_or.reduce(np.array(chosen, dtype=np.uint64))) ^ np.uint64((n + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        keys.append(x ^ (x >> np.uint64(31)))
    return keys


def groups_for(n: int) -> int:
    """How many groups cost least for n fingerprints. More of them make more grids, but cells of more bits: a segment's count tells 1.5 bits, so a fingerprint shares a cell with n / 2 ** (48 * (groups - 3) / groups) others; what is compared for a row stays within a bound that n does not raise."""
    cost = lambda g: comb(g, DISTANCE) * (1 + PAIR_COST * n / 2 ** (48 * (g - DISTANCE) / g))
    return min(range(GROUPS, MOST_GROUPS + 1), key=cost)


def linked(fp: np.ndarray, right: np.ndarray | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what links connect: (row, row of its root) for each row that is not a root.

    A link is a pair within the distance. right: only pairs with one row on each side.
    """
    total = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(total, kind="stable")
    fp, total = fp[order], total[order]
    side = right[order] if right is not None else None
    bytewise = np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int8)
    until = np.searchsorted(total, total + distance, side="right")
    after = until - np.arange(len(fp)) - 1
    upto = np.concatenate([[0], np.cumsum(after)])
    root = np.arange(len(fp))
    start = 0
    while start < len(fp):
        stop = max(start + 1, int(np.searchsorted(upto, upto[start] + PAIRS, side="right")) - 1)
        n = after[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        start = stop
        if side is not None:
            across = side[i] != side[j]
            i, j = i[across], j[across]
        near = np.abs(bytewise[i] - bytewise[j]).sum(axis=1) <= distance
        i, j = i[near], j[near]
        hit = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        i, j = i[hit], j[hit]
        while len(i):  # hook and jump until the ends of every link agree
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            root = root[root]
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
    while ((up := root[root]) != root).any():
        root = up
    moved = np.flatnonzero(root != np.arange(len(root)))
    return order[moved], order[root[moved]]


def links(prints: DataFrame, groups: int = GROUPS, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of nodes that connect all nodes which links connect. prints has a long node and its fingerprint fp."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for key in cell_keys(fp.view(np.uint64), groups, distance):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), pa.array(fp)], ["cell", "node", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (cell, i, j): a pair of blocks at a time."""

        def flush(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            head, node, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            right = None if head[0, 1] == head[0, 2] else head[:, 3].astype(bool)
            a, b = linked(fp.view(np.uint64), right, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            number = lambda k: batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            head = np.stack([number(k) for k in range(4)], axis=1)
            whole = head, number(4), number(5)
            cuts = [0, *(np.flatnonzero((head[1:, :3] != head[:-1, :3]).any(axis=1)) + 1).tolist(), n]
            if held and (held[-1][0][-1, :3] != head[0, :3]).any():
                yield from flush(held)
                held = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = tuple(x[a:b] for x in whole)
                if b < n:
                    if held or b - a > 1:
                        yield from flush([*held, part])
                    held = []
                else:
                    held.append(part)
        if held:
            yield from flush(held)

    members = kept_table(prints.select("node", "fp").mapInArrow(cells, "cell long, node long, fp long"), "cells")
    sizes = members.groupBy("cell").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = members.join(sizes, "cell").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("cell", "node", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "node", "fp")
    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(compare, "a long, b long")


def classes(rows: DataFrame, groups: int | None = None) -> DataFrame:
    """fp, n (rows that have it) and root (the smallest fingerprint that links reach) of each fingerprint of rows."""
    prints = kept_table(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "distinct")
    groups = groups or groups_for(prints.count())
    roots = components(links(prints.select(F.col("fp").alias("node"), "fp"), groups)).withColumnRenamed("node", "fp")
    return kept_table(prints.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "classes")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id that links of at most 3 differing bits reach, the row's own included.

    Null and empty texts have fingerprint 0 and link like any other; rows that repeat, or share a doc_id, each count; a null doc_id is no identifier, so a component of such rows only has null. Other columns of docs play no part. An empty table gives no rows.
    """
    rows = kept_table(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "prints")
    found = classes(rows, groups)
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = found.join(own, "fp")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = kept_table(rooted.select("fp", "n", "root").join(least, "root").drop("root"), "least")
    return lookup(rows, table, ["fp"], "n", rows.count()).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: int | None = None) -> DataFrame:
    """The rows of docs, all columns, one of each component: that with the smallest doc_id, null last; of rows that tie, one.

    Null and empty texts have fingerprint 0 and link like any other; columns of docs may have any names; an empty table gives no rows.
    """
    a, b = row_key(docs)
    rows = kept_table(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), a.alias("a"), b.alias("b"), F.col(text).alias("text"))), "prints")
    rooted = lookup(rows, classes(rows, groups), ["fp"], "n", rows.count())
    stays = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")).alias("one"))
    return stay(docs, kept_table(stays.select("one.a", "one.b"), "stays"))


#: Similar texts: sets of five-word shingles with a Jaccard similarity of 4 / 5 or more. The order of shingles is learnt from about SAMPLED texts: those that OFTEN or more of them hold come last, LISTED of these at most.
SIMILAR_SHINGLE, SAMPLED, OFTEN, LISTED = 5, 8000, 3, 100_000
#: Shingles of their prefixes that a pair must share to be a candidate, where its sizes do not ask for fewer.
SHARED = 8


def shingle_set(text: bytes | None) -> np.ndarray:
    """The hashes of a text's different shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text or b"", SIMILAR_SHINGLE), np.uint64))


def is_similar(common: np.ndarray | int, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of left and right members with so many in common have a Jaccard similarity of 4 / 5 or more, in whole numbers."""
    return 9 * common >= 4 * (left + right)


def prefix(members: np.ndarray, listed: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first members of a set, in the order of shingles, one of which every similar set has among its own first ones: similar sets share 4 / 5 of the members of each at least."""
    if not len(members):
        return members
    count = np.zeros(len(members), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, members), len(listed) - 1)
        count = np.where(listed[at] == members, times[at], 0)
    return members[np.argsort(count, kind="stable")[: len(members) - (4 * len(members) + 4) // 5 + 1]]


def _frequent(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts (node, text) hold, sorted, and about how many. It sets an order only, so what a sample misses costs time and no pair."""
    share = min(1.0, SAMPLED / max(1, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in texts_of(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], ["gram"])

    grams = texts.where(unit(F.col("node")) < share).select("text").mapInArrow(run, "gram long")
    top = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "gram").limit(LISTED).toArrow()
    listed, n = top["gram"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(listed)
    return listed[order], np.ceil(n[order] / share).astype(np.int64)


def candidates(sets: DataFrame, listed: np.ndarray, times: np.ndarray) -> DataFrame:
    """(a, b), a < b: the pairs of nodes of sets (node, size, prefix) that share enough shingles of their prefixes and may be similar by the places of these there; every similar pair is among them.

    A similar pair shares c = 4 / 9 of both sizes at least. Of these, all but those that stand behind the prefix stand in the prefix of the set whose prefix ends first, and so in both prefixes: one at least, a tenth of the texts if these are of one size. So it is asked for as many, up to SHARED; texts that share a shingle by chance, whose number grows with the square of the table, seldom do.

    A shingle is a cell. One that more than BLOCK texts are expected to have is compared block against block, each pair of blocks on its own.
    """
    hot = times > BLOCK
    shared = sets.sparkSession.sparkContext.broadcast((listed[hot], -(-times[hot] // BLOCK)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, blocks = shared.value
        for batch in batches:
            node, size = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            n = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cell = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            node, size = np.repeat(node, n), np.repeat(size, n)
            packed = (size << 32) | (at << 2)
            if len(hot):
                found = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
                parts = np.where(hot[found] == cell, blocks[found], 1)
                own = (_mixed(node.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                other = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                cell, node, packed, own = (np.repeat(x, parts) for x in (cell, node, packed, own))
                pair = (np.minimum(own, other) << 32) | np.maximum(own, other)
                cell = np.where(pair > 0, _mixed(cell ^ _mixed(pair.view(np.uint64))), cell)
                packed = packed | np.where(own == other, 0, np.where(own < other, 1, 2))  # of two blocks, only pairs across
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(node), pa.array(packed)], ["cell", "node", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (cell, node)."""

        def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.ones(rows.shape[1], bool)
            first[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)  # equal sets stand there once
            cell, node, packed = rows[:, first]
            size, at, side = packed >> 32, (packed & 0xFFFFFFFF) >> 2, packed & 3
            ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
            after = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(cell)) - 1
            upto = np.concatenate([[0], np.cumsum(after)])
            start = 0
            while start < len(cell):
                stop = max(start + 1, int(np.searchsorted(upto, upto[start] + PAIRS, side="right")) - 1)
                n = after[start:stop]
                i = np.repeat(np.arange(start, stop), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                start = stop
                common = (4 * (size[i] + size[j]) + 8) // 9
                need = np.minimum(common - (4 * np.maximum(size[i], size[j]) + 4) // 5 + 1, SHARED)
                # from each of a similar pair's first shared shingles on, both have all that they share but for the ones before
                may = (np.minimum(size[i] - at[i], size[j] - at[j]) > common - need) & (need > 0) & ((side[i] != side[j]) | (side[i] == 0))
                i, j, need = i[may], j[may], need[may]
                if len(i):
                    both, times = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), need]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(times)], ["a", "b", "need", "n"])

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            if held and (cut or held[-1][0, -1] != rows[0, 0]):
                yield from pairs(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            elif cut:
                yield from pairs(rows[:, :cut])
            held.append(rows[:, cut:])
        if held:
            yield from pairs(np.concatenate(held, axis=1))

    members = sets.select("node", "size", "prefix").mapInArrow(cells, "cell long, node long, packed long")
    return members.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(compare, "a long, b long, need long, n long").groupBy("a", "b", "need").agg(F.sum("n").alias("n")).where("n >= need").select("a", "b")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bins(members: np.ndarray) -> bytes:
    """A set in one to two bits a member: whether an odd number of them falls into each of a power of two of bins."""
    n = max(64, 1 << (len(members) - 1).bit_length()) if len(members) else 64
    return np.packbits(np.bincount((members & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1, bitorder="little").tobytes()


def _possible(pairs: DataFrame, binned: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets may be similar by their bins (node, size, bins): each bin that differs holds a member that only one of the sets has, so no similar pair goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sizes, others = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            first, second = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            lengths, kind = np.unique(np.array([(len(x), len(y)) for x, y in zip(first, second, strict=True)], np.int64).reshape(-1, 2), axis=0, return_inverse=True)
            apart = np.zeros(len(a), np.int64)
            for k, (m, n) in enumerate(lengths.tolist()):
                at, least = np.flatnonzero(kind == k), min(m, n)
                for some in np.array_split(at, -(-len(at) * max(m, n) // 4_000_000)):
                    # bins of the larger set that are one in the smaller one's are put together
                    left, right = (np.bitwise_xor.reduce(np.frombuffer(b"".join(x[r] for r in some), np.uint64).reshape(len(some), -1, least // 8), axis=1) for x in (first, second))
                    apart[some] = np.bitwise_count(left ^ right).sum(axis=1)
            hit = is_similar((sizes + others - apart) // 2, sizes, others)
            yield pa.RecordBatch.from_arrays([pa.array(a[hit]), pa.array(b[hit])], ["a", "b"])

    one, other = (binned.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab")
    return pairs.join(other, "b").join(one, "a").select("a", "b", "size_a", "size_b", "bins_a", "bins_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts (node, text) are similar, by a count of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, left = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            first, second = batch.column(2), batch.column(3)
            hits = []
            for k, node in enumerate(a):
                if node != seen:
                    seen, left = node, shingle_set(first[k].as_py())
                right = shingle_set(second[k].as_py())
                if is_similar(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right)):
                    hits.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in hits], pa.int64()), pa.array([b[k] for k in hits], pa.int64())], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def similar_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prints: bool = False) -> DataFrame:
    """The rows of docs, all columns, one of each group of similar texts: that with the smallest doc_id, null last; of rows that tie, one.

    Similar are texts whose sets of five-word shingles (64-bit hashes) have a Jaccard similarity of 0.8 or more, and with prints also those that simhash_components() links; a group is what such links connect. Candidates come from an exact prefix filter and are verified by a count of their shingles, those that their shingles' bins rule out aside, so no pair is missed and none is guessed. Null and empty texts are similar to each other only; columns of docs may have any names; an empty table gives no rows.
    """
    return stay(docs, finished(docs.sparkSession, "stays", lambda: _similar_stays(docs, doc_id, text, prints))[0])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """similar_dedup() of what near_dedup() leaves; of the tables between, the keys of the rows that stay are all that is left."""
    spark = docs.sparkSession
    linked, path = finished(spark, "linked", lambda: near_dedup(docs, doc_id, text))
    keys, _ = finished(spark, "stays", lambda: _similar_stays(linked, doc_id, text))
    drop(spark, path)
    return stay(docs, keys)


def _similar_stays(docs: DataFrame, doc_id: str, text: str, prints: bool = False) -> DataFrame:
    """The row_key (a, b) of the rows that similar_dedup() keeps. Tables go as soon as they are of no more use."""
    spark = docs.sparkSession
    a, b = row_key(docs)
    slim = docs.select(F.col(doc_id).alias("doc_id"), a.alias("a"), b.alias("b"), F.col(text).cast("binary").alias("text"))
    listed, times = _frequent(slim.select(F.col("a").alias("node"), "text"), docs.count())
    shared = spark.sparkContext.broadcast((listed, times))
    kind = slim.schema["doc_id"].dataType.simpleString()
    seed = SEED - 1
    while True:
        seed += 1
        made = slim.mapInArrow(_sets(shared, seed, prints), f"doc_id {kind}, a long, b long, node long, sure long, fp long, size long, bins binary, prefix array<long>")
        rows, path = stored(made, "sets")
        one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
        # equal sets are one node; two hashes tell whether it is one set
        nodes, where = stored(rows.groupBy("node").agg(F.min(one).alias("one"), (F.min("sure") != F.max("sure")).alias("clash")), "nodes")
        if nodes.where("clash").isEmpty():
            break
        drop(spark, path)
        drop(spark, where)
    pairs = kept_table(candidates(rows, listed, times), "pairs")
    ends_of = lambda some: some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
    # a set's bins come from the row that stands for the node
    binned = kept_table(rows.select("node", "a", "b", "size", "bins").join(nodes.join(ends_of(pairs), "node", "left_semi").select("node", "one.a", "one.b"), ["node", "a", "b"]).dropDuplicates(["node"]).select("node", "size", "bins"), "bins")
    printed = finished(spark, "printed", lambda: _print_links(rows))[0] if prints else None
    drop(spark, path)

    def similar(some: DataFrame) -> DataFrame:
        def verified() -> DataFrame:
            likely = kept_table(_possible(some, binned), "likely")
            wanted = nodes.join(ends_of(likely), "node", "left_semi").select("node", "one.a", "one.b")
            texts = kept_table(slim.select("a", "b", "text").join(wanted, ["a", "b"]).select("node", "text").dropDuplicates(["node"]), "texts")
            return _verified(likely, texts)

        return finished(spark, "similar", verified)[0]

    # each node with one other first: that links most of a large group, whose other pairs then need no look
    star = kept_table(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
    near = similar(star)
    near = near.union(printed) if prints else near
    roots = components(near)
    ends = pairs.join(star, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    rest = kept_table(ends.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "rest")
    if not rest.isEmpty():
        roots = components(near.union(similar(rest)))
    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return grouped.groupBy("root").agg(F.min("one").alias("one")).select("one.a", "one.b")


def _print_links(rows: DataFrame) -> DataFrame:
    """(a, b): each node of rows (node, fp) with the smallest of its class of linked fingerprints."""
    own = kept_table(rows.select("fp", "node").distinct(), "own")
    found = classes(own)
    rooted = kept_table(lookup(own, found, ["fp"], "n", own.count()).select("root", "node"), "rooted")
    least = rooted.groupBy("root").agg(F.min("node").alias("a"))
    return rooted.join(least, "root").where("a != node").select("a", F.col("node").alias("b"))


def _sets(shared, seed: int, prints: bool = False):
    """Rows (doc_id, a, b, text): two hashes of each text's shingle set, its fingerprint where it is asked for, its size, its bins and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                cut = batch.slice(start, 1000)
                texts = texts_of(cut, "text")
                sets = [shingle_set(x) for x in texts]
                firsts = [prefix(s, *shared.value) for s in sets]
                fp = np.array([simhash(shingle_hashes(x or b"")) if prints else 0 for x in texts], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, firsts)])
                arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts).view(np.int64)))
                halves = [pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), x) for s in sets], np.uint64).view(np.int64)) for x in (seed, seed + 1)]
                yield pa.RecordBatch.from_arrays([*cut.columns[:3], *halves, pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), pa.array([bins(s) for s in sets], pa.binary()), arrays], ["doc_id", "a", "b", "node", "sure", "fp", "size", "bins", "prefix"])

    return run
