"""Mixing, language, decontamination, quality, token files, HTML: brute force, round trips, held-out accuracy."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontam, html_extract, langid, mixing, pfor, quality, token_output

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above the bound goes to the others by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not above:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in above}


def test_targets(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {rng.choice(["a", "B", "é", "z", "src1", "src10", "src2"]): rng.choice([0, 1, 5, 100, 10_000]) for _ in range(6)} | {None: 50}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def brute_mix(docs, most=3, by_length=mixing.BY_LENGTH):
    """copies by row: Pareto order sampling of each source by plain sorts, from the same random numbers."""
    rows = [r.asDict() for r in mixing.measured(docs, "doc_id", "text", "source", 42).collect()]
    per = defaultdict(list)
    for r in rows:
        per[r["source"]].append(r)
    want = brute_targets({s: sum(r["size"] for r in g) for s, g in per.items()})
    for s, group in per.items():
        target, low, high = want[s], 0.0, 1e9
        g = lambda r: 2.0 ** (by_length * max(0, r["length"]))
        for _ in range(200):  # the level at which the expected words sum up to the target
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(most, mid * g(r)) * r["size"] for r in group) < target * (1 - 1e-13) else (low, mid)
        left = target
        for r in group:
            e = min(most, high * g(r)) if target else 0.0
            r["copies"] = int(e + 1e-7)
            r["p"] = max(0.0, e - r["copies"])
            left -= r["copies"] * r["size"]
        u, p = (lambda r: r["u"]), (lambda r: max(r["p"], 1e-9))
        order = sorted((r for r in group if r["copies"] < most), key=lambda r: (u(r) / (1 - u(r)) * (1 - p(r)) / p(r), r["_row"]))
        limit, first = float("inf"), left
        while order and left > 1e-9 and (limit == float("inf") or (left >= 1 and left > mixing.NEAR * target)):
            taken = 0  # up to the first of those that are small enough that does not fit
            for r in order:
                if 0 < r["size"] <= limit and r["size"] > left:
                    break
                taken += 1
                if r["size"] <= limit:
                    r["copies"] += 1
                    left -= r["size"]
            if taken == len(order):
                break
            order, limit = order[taken:], left
        assert first >= 0 or first > -1e-6
    return rows


def test_mix(larger):
    rows = mixing.pareto_mix(larger).collect()
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in larger.collect()}
    per = defaultdict(list)
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        per[r["source"]].append(r)
    want = brute_targets({s: sum(r["size"] for r in g) for s, g in per.items()})
    for s, g in per.items():
        assert g[0]["target"] == pytest.approx(want[s])
        assert want[s] * 0.99 <= sum(r["taken"] for r in g) <= want[s] + 1e-6
    again = mixing.pareto_mix(larger.repartition(5)).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}


def test_mix_equals_a_plain_pareto_sample(larger):
    want = {r["doc_id"]: r["copies"] for r in brute_mix(larger)}
    assert {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(larger).collect()} == want
    assert len({*want.values()}) == 4


def test_a_gap_is_filled_from_all_later_documents(make, monkeypatch):
    """A small source in a larger table, with documents that are too long for the gap."""
    monkeypatch.setattr(mixing, "SLICE", 4)
    docs = make([(k, "w " * (4000 if k % 40 == 7 else 3 + k % 5), None, "t" if k < 120 else "s") for k in range(3000)])
    rows = mixing.pareto_mix(docs).collect()
    assert {r["doc_id"]: r["copies"] for r in rows} == {r["doc_id"]: r["copies"] for r in brute_mix(docs)}


def test_inclusion_is_near_its_probability(make):
    """Over many draws a document is taken as often as its expected copies say, and longer ones more often."""
    docs = make([(k, "w " * (4 if k % 2 else 64), None, "s" if k < 4000 else "t") for k in range(4800)])
    plan = {(r["source"], r["length"]): r["certain"] + r["p"] for r in mixing._draw(docs, "doc_id", "text", "source", (1, 5), 3, 1.0, 0, 0.25)[1].collect()}
    assert plan["s", 6] > 1.5 * plan["s", 2] > 0
    took = defaultdict(list)
    for seed in range(2):
        for r in mixing.pareto_mix(docs, weights=(1, 5), seed=seed).collect():
            took[r["source"], r["size"].bit_length() - 1].append(r["copies"])
    for key in (("s", 2), ("s", 6)):
        assert np.mean(took[key]) == pytest.approx(plan[key], abs=0.03)


def test_rows_that_tie_are_cut_between(make):
    docs = make([(1, "some words of a row that repeats", None, "s")] * 400 + [(k, "w " * 7, None, "t") for k in range(400)])
    rows = [r for r in mixing.pareto_mix(docs, weights=(1, 3)).collect() if r["source"] == "s"]
    assert sum(r["taken"] for r in rows) == pytest.approx(rows[0]["target"], abs=7) and {r["copies"] for r in rows} == {0, 1}


def test_the_tables_of_the_mix_are_plain(larger, monkeypatch):
    """Each join of a table is planned, compiled and broadcast by the driver, once for each cut: two of them at most."""
    joins, real = [], mixing.kept_table

    def counted(df, name):
        joins.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), name))
        return real(df, name)

    monkeypatch.setattr(mixing, "kept_table", counted)
    mixing.mixed(larger)
    assert len([n for _, n in joins if n == "cuts"]) > 2 and max(joins)[0] <= 2


def test_mix_odd(odd, nothing):
    out = mixing.pareto_mix(odd).collect()
    assert len(out) == odd.count()
    assert {r["taken"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.pareto_mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in out)


# language


def test_language(larger):
    rows = langid.language_id(larger).join(larger.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bloom_holds_all_and_corrects():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 2**32, 40_000, dtype=np.uint64)
    langs = rng.integers(0, 3, 40_000)
    f = langid.Filter.of(["a", "b", "c"], grams, langs, bits=14)
    assert ((f.masks_of(grams) >> langs.astype(np.uint64)) & np.uint64(1)).all()
    other = rng.integers(2**33, 2**34, 200_000, dtype=np.uint64)
    rate = [float(((f.masks_of(other) >> np.uint64(k)) & np.uint64(1)).mean()) for k in range(3)]
    assert rate == pytest.approx(f.false.tolist(), abs=0.02) and min(rate) > 0.2


def test_language_is_of_the_text_alone(larger):
    changed = larger.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = ({r["doc_id"]: r["lang_pred"] for r in langid.language_id(d).collect()} for d in (larger, changed))
    assert a == b


def test_language_equals_sets_of_ngrams(larger):
    """Against plain sets in place of the filter: its counts are near theirs, its decisions the same but for near ties."""
    learn = larger.where(~langid.held_out()).where("lang IS NOT NULL")
    model = langid.train(learn, least=0.0)
    held: dict[str, set] = defaultdict(set)
    for r in learn.collect():
        held[r["lang"]] |= {*langid.grams(langid.folded(r["text"].encode())).tolist()}
    told, same = 0, 0
    for r in larger.where(langid.held_out()).collect():
        values = langid.grams(langid.folded(r["text"].encode())).tolist()
        exact = np.array([sum(v in held[x] for v in values) for x in model.names], float)
        counts, n = model.counts(r["text"].encode())
        assert n == len(values) and np.abs(counts - exact).max() <= 0.05 * n + 3
        told += 1
        same += model.names[int(np.argmax(counts))] == model.names[int(np.argmax(exact))] or np.ptp(np.sort(exact)[-2:]) <= 0.05 * n
    assert told > 150 and same == told


def test_more_languages_than_bits_of_a_word(make):
    rng = random.Random(3)
    names = [f"l{k:03d}" for k in range(70)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for x in names}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x, "s") for i, x in enumerate(names * 8)]
    want = {r[0]: r[2] for r in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in langid.language_id(make(rows)).collect()} == want


def test_language_odd(odd, nothing, larger):
    out = langid.language_id(odd).collect()
    assert len(out) == odd.count()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in out if r["doc_id"] == 8} >= {"und"}
    assert langid.language_id(nothing).count() == 0 and langid.accepted(nothing).count() == 0
    extra = odd.select(*larger.columns)
    left = langid.accepted(larger.unionByName(extra))
    assert left.columns == larger.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert ids >= {r["doc_id"] for r in larger.collect()} and left.where("text IS NULL OR text = ''").count() == 0


# decontamination


def brute_hits(texts, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = decontam.words(t.encode() if t is not None else None)
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a : a + size])].add(str(i))
    out = []
    for t in texts:
        w = decontam.words(t.encode() if t is not None else None)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    found |= own
                    hit.update(range(a, a + n))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 30])
def test_decontamination_equals_brute_force(spark, make, block):
    rng = random.Random(block)
    word = lambda: rng.choice("ab cd Éé ef gh 12 zz ö".split())
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 9, 10, 11, 25, 40, 40, 12])] + [(99, None), (98, " .,; "), (10, "zz-ZZ zz"), (10, "zz-ZZ zz")]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 15)))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [",".join(w[a : a + rng.randint(1, 20)]), word()]
        texts.append(" ".join(parts))
    texts += [None, "", "x" * 50]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.digest(decontam.decontaminate(make(list(enumerate(texts))), bench, block_words=block)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in out] == brute_hits(texts, items)


def test_decontamination_odd(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "same text here"), (None, "other text")], "item_id long, text string")
    out = decontam.digest(decontam.decontaminate(odd, bench)).collect()
    assert len(out) == odd.count()
    assert sorted(str(r["doc_id"]) for r in out if r["contaminated"]) == ["6", "8", "None", "None"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(odd, empty).where("size(hits) > 0").count() == 0
    assert decontam.decontaminate(nothing, bench).count() == 0
    left = decontam.clean(odd, bench, block_words=2)
    assert left.columns == odd.columns and left.count() == odd.count() - 4
    assert decontam.clean(odd, empty).count() == odd.count()


# quality


def test_quality(spark, larger):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(larger, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.classify(larger, flipped).collect()} == {r["doc_id"]: r["score"] for r in quality.classify(larger, labels).collect()}


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x, y, trees=30)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            at = 0
            while f[at] >= 0:
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += v[at]
        return total

    assert forest.raw(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_trees_equal_plain_loops():
    """Splits of the histograms against a search of all thresholds by loops."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (60, 3)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 4) + rng.integers(0, 4, 60) > 9).astype(float)
    forest = quality.fit(x, y, trees=5, depth=2, bins=64)
    raw = np.full(60, np.log((y.sum() + 0.5) / 61 / (1 - (y.sum() + 0.5) / 61)))

    def grow(rows, g, h, depth):
        sg, sh = g[rows].sum(), h[rows].sum()
        value = -quality.RATE * sg / (sh + quality.RIDGE)
        best = (1e-6, None)
        for f in range(3) if depth and len(rows) >= 2 * quality.LEAST_CHILD else []:
            for at in sorted({*x[:, f].tolist()})[:-1]:
                left = [r for r in rows if x[r, f] <= at]
                if min(len(left), len(rows) - len(left)) < quality.LEAST_CHILD:
                    continue
                a, b = g[left].sum(), h[left].sum()
                gain = a * a / (b + quality.RIDGE) + (sg - a) ** 2 / (sh - b + quality.RIDGE) - sg * sg / (sh + quality.RIDGE)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, at))
        if best[1] is None:
            return {r: value for r in rows}
        f, at = best[1]
        return grow([r for r in rows if x[r, f] <= at], g, h, depth - 1) | grow([r for r in rows if x[r, f] > at], g, h, depth - 1)

    for _ in range(5):
        p = 1 / (1 + np.exp(-raw))
        leaves = grow(list(range(60)), p - y, np.maximum(p * (1 - p), 1e-9), 2)
        raw = raw + np.array([leaves[r] for r in range(60)])
    assert forest.raw(x) == pytest.approx(raw)


def test_quality_learns_the_same_in_any_order(spark, larger):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a, b = (quality.train(quality.measured(d).where(~quality.held_out()), labels) for d in (larger, larger.repartition(7)))
    assert (a.threshold == b.threshold).all() and (a.value == b.value).all() and len(a.value) == quality.TREES


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(6, 1, "a"), (9, 0, "b"), (None, 1, "c"), (7, None, "d")], "doc_id long, quality int, text string")
    out = quality.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


# token files


@pytest.mark.parametrize("seed", range(4))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, rng.choice([1, 2, 300, 50_000, 2**32]), rng.integers(0, 9000), dtype=np.uint64).astype(np.uint32) for _ in range(30)]
    docs += [np.empty(0, np.uint32), np.array([2**32 - 1, 0], np.uint32), np.full(5000, 7, np.uint32)]
    out = io.BytesIO()
    writer = pfor.Writer(out, block=1024)
    for k, d in enumerate(docs):
        writer.add(None if k == 3 else k - 5, d)
    writer.close()
    back = list(pfor.read(io.BytesIO(out.getvalue())))
    assert [i for i, _ in back] == [None if k == 3 else k - 5 for k in range(len(docs))]
    assert all((a == b).all() and len(a) == len(b) for (_, a), b in zip(back, docs, strict=True))
    joined = np.concatenate(docs)
    for k in (0, len(joined) // 1024 // 2, len(joined) // 1024):
        assert (pfor.block(io.BytesIO(out.getvalue()), k) == joined[k * 1024 : (k + 1) * 1024]).all()


def test_outliers_do_not_widen_a_block():
    few = np.arange(4096, dtype=np.uint32) % 200
    many = few.copy()
    many[::100] = 1 << 30
    assert len(pfor.pack(many)) < len(pfor.pack(few)) + 42 * 8
    assert (pfor.unpack(pfor.pack(many)) == many).all()


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_encoder_equals_the_library():
    enc, rng = token_output.Encoder(token_output.tokenizer_path()), random.Random(7)
    bits = ["a", "B", "'s", "é", "É", " ", "\n", ".", ",", "<|endoftext|>", "<|ENDOFTEXT|>", "…", "9", "İ", "ß", "Σ", "́", " ", "—", "'", "re", "ﬁ", "\x1c", "\x85", "zz", "語", "!!", "***", "\t", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    got = [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(pa.array([t.encode() for t in texts])).to_pylist()]
    assert got == reference_ids(texts)
    assert np.frombuffer(enc.encode(pa.array([b"ab\xff cd", None])).to_pylist()[0], enc.kind).tolist() == reference_ids(["ab� cd"])[0]


def test_a_full_memory_changes_nothing(documents, monkeypatch):
    texts = [r["text"] for r in documents.limit(60).collect()]
    monkeypatch.setattr(token_output, "REMEMBERED", 500)
    enc = token_output.Encoder(token_output.tokenizer_path())
    got = [np.frombuffer(x, enc.kind).tolist() for t in texts for x in enc.encode(pa.array([t.encode()])).to_pylist()]
    assert got == reference_ids(texts)


def test_token_output(spark, documents):
    out, folder = token_output.token_output(spark, documents, token_output.tokenizer_path(), files=5)
    rows = documents.orderBy("doc_id").collect()
    want, start = [], 0
    for r, ids in zip(rows, reference_ids([r["text"] for r in rows]), strict=True):
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in out.orderBy("start").collect()] == want


def test_token_output_odd(spark, odd, nothing):
    out = token_output.token_output(spark, odd, token_output.tokenizer_path(), files=3)[0].orderBy("start").collect()
    assert len(out) == odd.count()
    ids = [r["doc_id"] for r in out]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert Counter(r["n_tokens"] for r in out)[1] == 3
    assert [r["start"] for r in out] == np.cumsum([0, *(r["n_tokens"] for r in out[:-1])]).tolist()
    assert token_output.token_output(spark, nothing, token_output.tokenizer_path())[0].count() == 0


def test_token_files_stay_and_are_read_by_themselves(spark, make, tmp_path):
    """A doc_id that many rows have, and nulls, fill several files; the folder tells all."""
    docs = make([(7 if k % 2 else None if k % 3 else k, f"text number {k}") for k in range(600)])
    folder = f"file://{tmp_path}/out"
    out, told = token_output.token_output(spark, docs, token_output.tokenizer_path(), folder=folder, files=12)
    assert told == folder
    first = sorted(tuple(r) for r in out.select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    ids = [r[1] for r in first]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x) and len(ids) == 600
    assert [r[0] for r in first] == np.cumsum([0, *(r[2] for r in first[:-1])]).tolist()
    sizes = [r["n_docs"] for r in spark.read.parquet(f"{folder}/{token_output.MANIFEST}").collect()]
    assert max(sizes) <= 150 and len(sizes) >= 9
    assert sorted(tuple(r) for r in token_output.read_files(spark, folder).select("start", "doc_id", "n_tokens", "ids_crc32").collect()) == first
    again = token_output.token_output(spark, docs.repartition(3), token_output.tokenizer_path(), files=12)
    assert sorted(tuple(r) for r in again[0].select("start", "doc_id", "n_tokens", "ids_crc32").collect()) == first
    from tidelog.functions import store

    assert again[1] not in store._made


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T &amp; more</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
%s<aside>Side</aside><div class="ad">Buy</div><form><p>Your mail</p><input name=q></form><section id="comments"><p>First!</p></section><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Ti.</h1><p><b>One &lt;two&gt; &amp;amp; it&#39;s\n  &eacute;<br><p>Ti.</p><p>a<i>b</i>c</p></article>", "Ti. One <two> &amp; it's é Ti. abc"),
        ('<article class="post"><p>x</p><div class="share"><p>Tweet</p></div><aside>s</aside><p>y</p></article>', "x y"),
        ("<main><p>Only main</p></main>", "Only main"),
        ("<div><p>" + "long text of the page " * 8 + "</p><p>short</p><p>" + "more of it here " * 9 + "</p></div>", ("long text of the page " * 8 + "short " + "more of it here " * 9).strip()),
        ("<article></article>", ""),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p title='a>b'>quoted</p><p data-x=\"<p>\">more</p></article>", "quoted more"),
    ],
)
def test_extract(body, want):
    assert html_extract.extract(PAGE % body) == want


P = "<p>This is a paragraph of the article, with some words in it.</p>"
SAID = "This is a paragraph of the article, with some words in it."
LINKS = "<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>About</a></ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # a class tells by whole tokens and their head word, never on an element around the article
        (f'<div class="layout no-sidebar"><article>{P}</article></div>', SAID),
        (f'<div class="page with-sidebar"><article>{P}</article></div>', SAID),
        (f'<div class="sidebar-right"><article>{P}</article></div>', SAID),
        (f'<aside class="sidebar"><div><main>{P}</main></div></aside>', SAID),
        (f'<div id="content" class="has-ads">{P}</div>', SAID),
        (f'<body class="sidebar-open modal">{P}</body>', SAID),
        (f'<div title="the hidden cost of x" data-class="ad">{P}</div>', SAID),
        (f"<div hidden><p>not shown</p></div><p data-hidden=1>{SAID}</p>", SAID),
        # in an article only what the contract names goes
        (f'<article>{P}<section class="related-work">a</section><section id="search-algorithms">b</section><p id="notice-1">c</p><p class="search">d</p><h2 id="sharing-data">e</h2></article>', f"{SAID} a b c d e"),
        (f"<article><header><h1>Title</h1></header>{P}<figure><img><figcaption>a caption</figcaption></figure><math><mi>x</mi></math> <object>an object</object></article>", f"Title {SAID} a caption x an object"),
        (f'<article>{P}<div class="ad-slot">buy</div><div id="comments"><article class="comment">long {P * 9}</article></div>{P}</article>', f"{SAID} {SAID}"),
        # the marked article does not hold the text
        (f"<h1>Title</h1>{P}<article><p>Teaser.</p></article>", f"Title {SAID} Teaser."),
        (f"<aside><article><p>Teaser.</p></article></aside>{P}", SAID),
        (f"<div>Outside</div><article>{P}</article><div>Outside too</div>", SAID),
        # nothing is marked
        (f"{P}<p><a href=x>a paragraph that is a link</a></p>", f"{SAID} a paragraph that is a link"),
        ("<p><a href=x>all of it is a link</a></p>", "all of it is a link"),
        (f"{P}<p>a</p><p>b</p><p>c</p><p>d</p><p>last short one</p>", f"{SAID} a b c d last short one"),
        (f"<p>a</p><p>b</p><p>c</p><p>d</p>{P}", f"a b c d {SAID}"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        (f"{LINKS}{P}{LINKS}", SAID),
        (f"<div><a href=a>Home</a> | <a href=b>News</a> | <a href=c>About</a></div>{P}", SAID),
        (f"<article>{P}{LINKS}</article>", f"{SAID} Home News About"),
        (LINKS, ""),
        # frames, markup that is left open, odd attributes
        (f"<form action=x><header>Site</header><h1>Title</h1>{P}<input><label>Name</label></form>", f"Title {SAID}"),
        ("<h1>Contact</h1><form><p>Your name, your address and what you want to tell us</p><input></form>", "Contact"),
        (f"<nav><a href=x>Home</a><article>{P}</article>", SAID),
        ("<p class=it's>a</p><p>b's</p><p x='>'>c", "a b's c"),
        ("a<b>b</b>c &lt;x&gt; &#39; &amp<i>amp;</i> x < y <!-- c --> z<![CDATA[<q>]]>", "abc <x> ' &amp; x < y z<q>"),
        ("<body><div><p>one<p>two</b></div></div></section>three", "one two three"),
    ],
)
def test_extract_contract(page, want):
    assert html_extract.extract(page) == want


class Walk(HTMLParser):
    """The text of a page of neutral and of stripped elements, by the library's parser: whether any open element goes."""

    BLOCKS, GONE = {"p", "div", "h1", "li", "ul", "td", "tr", "table", "blockquote", "section", "article", "nav", "footer", "aside"}, {"nav", "footer", "aside", "script", "style"}

    def __init__(self):
        super().__init__()
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS or tag == "br":
            self.out.append("\n")
        if tag != "br":
            quote = tag == "footer" and self.open[-1][0] == "blockquote"  # whose footer names its source
            self.open.append((tag, tag in self.GONE and not quote or dict(attrs).get("class") in ("ad", "site-footer", "comments")))

    def handle_endtag(self, tag):
        self.open.pop()
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not any(gone for _, gone in self.open):
            self.out.append(data)


def test_extract_equals_a_walk_of_the_document():
    rng = random.Random(7)

    def element(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(["some words ", "a &amp; b\n", " &lt;tag&gt; ", "é\xa0ü  ", "x", "<br>", "<!-- no -->"])
        tag = rng.choice(["p", "div", "h1", "b", "i", "span", "blockquote", "section", "nav", "footer", "aside", "div class='ad'", "div class=\"site-footer\"", "section id=c class=comments", "div class='no-ads main'", "script", "table"])
        name = tag.split()[0]
        if name == "script":
            return "<script>var x = '<p>no</p>';</script>"
        if name == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{element(depth - 2) if depth > 1 else 'cell'}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        inner = "".join(element(0 if name in ("p", "h1", "b", "i", "span") else depth - 1) for _ in range(rng.randint(1, 4)))
        return f"<{tag}>{inner}</{name}>"

    for _ in range(400):
        page = "<html><body>" + "".join(element(4) for _ in range(rng.randint(1, 6))) + "</body></html>"
        walk = Walk()
        walk.feed(page)
        walk.close()
        lines = (" ".join(line.split()) for line in re.split("\x0b", "".join("\x0b" if x == "\n" else x for x in walk.out)))
        assert html_extract.extract(page) == " ".join(x for x in lines if x)


def test_a_page_that_ends_in_a_tag():
    assert html_extract.extract("<nav>n</nav><article><p>tag cut <b") == "tag cut"


def test_extract_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    for r, got in zip(pages.orderBy("page_id").collect(), html_extract.extract_pages(pages).orderBy("page_id").collect(), strict=True):
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in re.split("</?(?:p|h1|br)>", inner)]
        assert got["text"] == " ".join(p for p in parts if p) and got["n_chars"] == len(got["text"]) and got["url"] == r["url"]


def test_extract_odd(spark):
    long_ = "<article>" + "<p>many words here</p>" * 30_000 + "</article>"
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "no markup", "t"), (3, "u", "no markup", "t"), (None, "u", long_, "t"), (4, "u", "<<<>>> & &#xZZ; </p></div><a", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.extract_pages(pages).collect()
    assert [r["text"] for r in out[:4]] == ["", "", "no markup", "no markup"]
    assert out[4]["n_chars"] == 30_000 * 16 - 1 and len(out) == 6
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_extract_never_fails():
    rng = random.Random(1)
    bits = ["<", ">", "<p>", "</p>", "<article>", "</article>", "<!--", "-->", "<script>", "</script>", '"', "'", "&amp", ";", "text ", "<a href=", "<nav>", "</nav>", "<div class='ad'>", "</div>", "<![CDATA[", "]]>", "/", "="]
    for _ in range(2000):
        html_extract.extract("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
