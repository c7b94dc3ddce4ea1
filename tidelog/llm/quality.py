"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts gives each document a row of statistics. A bounded sample of the labelled rows trains the trees on the driver, feature by feature in histograms of at most BINS bins. The trees are flattened into arrays, which numpy walks level by level for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import crc32_mod, kept_table, slices, texts_of, unit

#: Labelled rows that are learnt from, about so many at most, by hash.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_CHILD, RIDGE = 80, 4, 64, 0.15, 5, 1.0
#: From this score on a row counts as good (fixed by the contract).
THRESHOLD = 0.3

#: The statistics, in the order of statistics().
NAMES = ("log_chars", "log_words", "log_lines", "chars_per_word", "words_per_line", "letters", "upper", "digits", "spaces", "non_ascii", "marks", "exclaim", "pipes", "symbols", "stars_hashes", "top_byte", "distinct_words", "repeated_lines", "short_words", "long_words", "top_word", "marked_words", "sentence_ends", "entropy")

_CLASS = np.zeros((256, 9), np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [(_b < 128 and _c.isalpha()) or _b >= 128, _b < 128 and _c.isupper(), _c.isdigit() and _b < 128, _b in (9, 10, 11, 12, 13, 32), _b >= 128, _c in ".,;:?'\"()-", _c == "!", _c == "|", _c in "&%$#*@~^<>{}[]\\/=+_"]


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a text, empty and null ones too."""
    t = text or b""
    n = len(t)
    counts = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    letters, upper, digits, spaces, high, marks, exclaim, pipes, symbols = (counts @ _CLASS).tolist()
    words, lines = t.split(), [x for x in t.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    nw, nl, size = len(words), len(lines), max(1, n)
    lengths = np.fromiter(map(len, words), np.int64, nw)
    share = counts[counts > 0] / size
    return [
        np.log1p(n), np.log1p(nw), np.log1p(nl), n / max(1, nw), nw / max(1, nl), letters / size, upper / max(1, letters), digits / size, spaces / size, high / size,
        marks / size, exclaim / size, pipes / size, symbols / size, float(counts[42] + counts[35]) / size, float(counts[[*range(33, 127)]].max()) / size,
        len(seen) / max(1, nw), 1 - len({*lines}) / max(1, nl), float((lengths <= 2).mean()) if nw else 0.0, float((lengths >= 12).mean()) if nw else 0.0,
        max(seen.values(), default=0) / max(1, nw), sum(w[-1] in b"!|&%$#*" for w in words) / max(1, nw), float(counts[46] + counts[63]) / max(1, nw), float(-(share * np.log2(share)).sum()) if n else 0.0,
    ]


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts):
                x = np.array([statistics(t) for t in texts[a:b]], np.float32)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), values], ["doc_id", "x"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, x array<float>")


@dataclass
class Forest:
    """Trees in flat arrays, one row for each tree, nodes in heap order: feature (-1 at a leaf), threshold (greater goes right), value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value) + 1)) - 1):
                f = feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > threshold[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Trees for labels 0 and 1 under logistic loss. Without rows, or with rows of one label only, a forest of no trees with their mean."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    nodes = 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.empty((0, nodes), np.int64), np.empty((0, nodes), np.float32), np.empty((0, nodes)), base)
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # above edge k - 1, at most edge k
    flat = binned + np.arange(n_features) * bins
    raw = np.full(len(y), base)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, value = np.full(nodes, -1, np.int64), np.zeros(nodes, np.float32), np.zeros(nodes)
        members = {0: np.arange(len(y))}
        for node in range(nodes):
            own = members.pop(node, None)
            if own is None:
                continue
            sg, sh = g[own].sum(), h[own].sum()
            value[node] = -rate * sg / (sh + RIDGE)
            if node >= nodes // 2 or len(own) < 2 * LEAST_CHILD:
                continue
            cells = flat[own].ravel()
            hist = [np.bincount(cells, weights=np.repeat(v, n_features), minlength=n_features * bins).reshape(n_features, bins).cumsum(axis=1)[:, :-1] for v in (g[own], h[own], np.ones(len(own)))]
            gl, hl, nl = hist
            gain = gl**2 / (hl + RIDGE) + (sg - gl) ** 2 / (sh - hl + RIDGE) - sg**2 / (sh + RIDGE)
            gain[(nl < LEAST_CHILD) | (len(own) - nl < LEAST_CHILD)] = -1
            for f, e in enumerate(edges):
                gain[f, len(e) :] = -1
            best = int(np.argmax(gain))
            f, k = divmod(best, bins - 1)
            if gain[f, k] <= 1e-6:
                continue
            feature[node], threshold[node] = f, edges[f][k]
            right = binned[own, f] > k
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
        made.append((feature, threshold, value))
        at = Forest(feature[None], threshold[None], value[None], 0.0)
        raw += at.raw(x)
    return Forest(*(np.stack(a) for a in zip(*made, strict=True)), base)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The contract's fold: rows whose labels nothing is learnt from."""
    return crc32_mod(doc_id, 5) == 0


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """From measured rows and labels (doc_id and the label), joined, the rows whose hash lies in the share that makes about sample rows; a null label or doc_id teaches nothing. Empty and null texts teach as what they are; rows that repeat teach each; reruns give the same trees; without rows the forest is the prior."""
    known = labels.select(F.col("doc_id"), F.col(label).alias("_y")).where(F.col("_y").isNotNull())
    share = sample / max(1, known.count())
    taught = rows.join(known.where(unit(F.col("doc_id").cast("string")) < share), "doc_id")
    table = taught.select("x", F.col("_y").cast("double").alias("_y"), "doc_id").toArrow()
    # sums of floats depend on their order, and tasks end in any: the rows are learnt from in one that they fix themselves
    table = table.take(pa.array(sorted(range(len(table)), key=list(zip(table["doc_id"].to_pylist(), table["_y"].to_pylist(), table["x"].to_pylist(), strict=True)).__getitem__), pa.int64()))
    y = table["_y"].to_numpy()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if len(y) else np.empty((0, len(NAMES)), np.float32)
    return fit(x.astype(np.float32), y)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs: learnt from labelled rows outside the fold, told for all.

    Null and empty texts have the statistics of an empty text; rows that repeat are told each; without labels every score is the prior of one half. No column but the text is an input; other columns play no part, whatever their names. An empty table gives no rows.
    """
    rows = kept_table(measured(docs, doc_id, text), "statistics")
    forest = train(rows.where(~held_out()), labels, label)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    told = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return told.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
