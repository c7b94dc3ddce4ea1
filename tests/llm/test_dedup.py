"""Exact, near and substring dedup, and line templates, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import components, exact_dedup, line_template, simhash, suffix_array, suffix_dedup

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# exact dedup


def test_exact_equals_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[WHITE.sub(" ", r["text"])].append(r["doc_id"])
    want = sorted(((d, min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g), key=repr)
    assert collected(exact_dedup.exact_dedup(documents), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_rounds(documents, monkeypatch):
    one = collected(exact_dedup.exact_dedup(documents), "doc_id", "keep_id", "group_size", "kept")
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    assert collected(exact_dedup.exact_dedup(documents.repartition(7)), "doc_id", "keep_id", "group_size", "kept") == one


def test_exact_odd(odd, nothing):
    out = exact_dedup.exact_dedup(odd).collect()
    assert len(out) == odd.count()
    by = defaultdict(list)
    for r in out:
        by[r["text_sha256"]].append(r)
    assert all(sum(r["kept"] for r in g) == 1 and all(r["group_size"] == len(g) for r in g) for g in by.values())
    blank = [r for r in out if r["doc_id"] in (1, 2)]
    assert [r["keep_id"] for r in blank] == [1, 1]
    assert exact_dedup.exact_dedup(nothing).count() == 0


# SimHash


def fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(fps):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_simhash_equals_brute_force(documents):
    rows = documents.orderBy("doc_id").select("doc_id", "text").collect()
    fps = [fingerprint(r["text"]) for r in rows]
    label = brute_classes(fps)
    out = simhash.simhash_components(documents).orderBy("doc_id").collect()
    assert [r["fp"] & (2**64 - 1) for r in out] == fps
    assert [r["component_id"] for r in out] == [rows[k]["doc_id"] for k in label]


def planted(n, seed):
    """Fingerprints in chains and clusters at distances around the limit, and unrelated ones."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5])):
                x ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize("groups", [4, 5, 6])
def test_links_lose_nothing(spark, groups, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)  # every cell is compared block against block
    fps = planted(400, groups)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    table = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(table, groups)).collect()}
    label = brute_classes(fps)
    want = [frozenset(k for k in range(len(fps)) if label[k] == label[i]) for i in range(len(fps))]
    mine = defaultdict(set)
    for k, x in enumerate(signed):
        mine[roots.get(x, x)].add(k)
    assert {frozenset(g) for g in mine.values()} == set(want)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    counts = [np.bitwise_count(x.view(np.uint8).reshape(-1, 8)).astype(int) for x in (a, b)]
    assert (np.abs(counts[0] - counts[1]).sum(axis=1) <= np.bitwise_count(a ^ b)).all()


def test_spark_agrees_on_the_hash(spark):
    words = ["the cat sat", "é ü ñ", ""]
    told = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert told == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_simhash_odd(odd, nothing):
    out = simhash.simhash_components(odd).collect()
    assert len(out) == odd.count()
    by = defaultdict(set)
    for r in out:
        by[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert len(by[4]) == 1 and {c for _, c in by[5]} == {4}
    assert {c for _, c in by[None]} == {6}
    assert simhash.simhash_components(nothing).count() == 0
    left = simhash.near_dedup(odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "4", "6", "7", "8", "8", "9"]
    assert simhash.near_dedup(nothing).count() == 0


def test_names_and_hashes_that_clash(spark, monkeypatch):
    """Columns named like ours stay; sets that share a hash are told apart by another seed."""
    docs = spark.createDataFrame([(1, "a b c d e f g", 7, "x", None), (2, "a b c d e f g", 8, "y", 1), (3, "another text of some words", 9, None, "z"), (4, "a third text of some words here", 9, "z", None)], "doc_id long, text string, _key long, a string, b string")
    for dedup in (simhash.near_dedup, simhash.similar_dedup):
        assert sorted(tuple(r) for r in dedup(docs).collect()) == sorted(tuple(r) for r in docs.where("doc_id != 2").collect())
    real, seeds = simhash._sets, []

    def weak(shared, seed, prints):
        seeds.append(seed)
        run = real(shared, seed, prints)

        def clash(batches):
            for batch in run(batches):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([5] * batch.num_rows, pa.int64()), *batch.columns[4:]], batch.schema.names)

        return clash if len(seeds) < 3 else run

    monkeypatch.setattr(simhash, "_sets", weak)
    assert simhash.similar_dedup(docs).count() == 3 and len(seeds) == 3


def test_near_dedup_keeps_one_of_rows_that_repeat(make):
    out = simhash.near_dedup(make([(5, "one two three four")] * 3 + [(6, "quite another text")])).collect()
    assert sorted(r["doc_id"] for r in out) == [5, 6]


def mutated(words, rate, rng):
    return [f"neu{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_are_one_group(make):
    rng = random.Random(11)
    rows, near, k = [], [], 0
    for _ in range(60):
        words = [f"w{min(rng.randrange(1, 4000) for _ in range(3))}" for _ in range(rng.randint(150, 500))]
        rows.append((k, " ".join(words)))
        for rate in (0.008, 0.015, 0.12):
            copy = mutated(words, rate, rng)
            rows.append((k + 1 + (0.008, 0.015, 0.12).index(rate), " ".join(copy)))
            near.append((k + 1 + (0.008, 0.015, 0.12).index(rate), jaccard(words, copy)))
        k += 10
    left = {r["doc_id"] for r in simhash.similar_dedup(make(rows)).collect()}
    assert all(d in left for d in range(0, 600, 10))  # the smallest of each group
    close = [d for d, c in near if c >= 0.8]
    far = [d for d, c in near if c < 0.6]  # the copies of a text are not similar through each other
    assert len(close) > 40 and len(far) > 30
    assert not any(d in left for d in close) and all(d in left for d in far)


def test_groups_follow_the_number_of_fingerprints():
    """What a fingerprint is compared with does not grow with the table."""
    assert simhash.groups_for(1000) == simhash.GROUPS
    per_row = [simhash.comb(g, 3) * n / 2 ** (48 * (g - 3) / g) for n in (10**5, 10**6, 10**7, 10**8, 10**9, 10**10, 10**11) for g in [simhash.groups_for(n)]]
    assert max(per_row) < 1500 and per_row[-1] < 1500


def test_similar_odd(odd, nothing, make):
    left = simhash.similar_dedup(odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "4", "6", "7", "8", "8", "9"]
    assert simhash.similar_dedup(nothing).count() == 0
    assert [r["doc_id"] for r in simhash.similar_dedup(make([(5, "one two three")] * 3)).collect()] == [5]


def passage_copies(seed, n=30):
    """Texts and copies of each with a passage appended, cut off or replaced, at a Jaccard similarity of 0.80 to 0.85."""
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(1, 9000) for _ in range(2))}"
    texts = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(200, 600))]
        size = len(words)
        more, block = int(size * 0.2), int(size * 0.09)
        cut = rng.randint(10, size - block - 10)
        texts.append((words, words + [word() for _ in range(more)], words[: int(size * 0.83)], words[:cut] + [word() for _ in range(block)] + words[cut + block :]))
    return texts


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_copies_with_another_passage_are_found(make, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    groups = passage_copies(block)
    assert all(0.8 <= jaccard(g[0], c) < 0.86 for g in groups for c in g[1:])
    rows = [(10 * k + at, " ".join(g[at])) for k, g in enumerate(groups) for at in (0, 1 + k % 3)]
    left = {r["doc_id"] for r in simhash.similar_dedup(make(rows)).collect()}
    assert left == {10 * k for k in range(len(groups))}


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_similar_equals_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    texts, common = [], [f"c{k}" for k in range(12)]
    for _ in range(25):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 6, 9, 40, 90]))] + common * rng.randint(0, 1)
        texts += [words, *([*words[rng.randint(0, len(words) // 9) :], *("ab" * rng.randint(0, len(words) // 8))] for _ in range(3))]
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if jaccard(a, b) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    left = simhash.similar_dedup(make([(k, " ".join(w)) for k, w in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(root))


def test_texts_that_share_a_shingle_by_chance_are_no_candidates(spark):
    rng = np.random.default_rng(8)
    shared = np.array([1], np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(2, 2**63, 299, dtype=np.uint64)])) for _ in range(40)]
    sets += [np.unique(np.concatenate([sets[0][:290], rng.integers(2, 2**63, 10, dtype=np.uint64)]))]
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = [(k, len(x), simhash.prefix(x, *none).view(np.int64).tolist()) for k, x in enumerate(sets)]
    found = simhash.candidates(spark.createDataFrame(rows, "node long, size long, prefix array<long>"), *none)
    assert [tuple(r) for r in found.collect()] == [(0, 40)]


def test_bins_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(6)
    sets, pairs = [], []
    for k in range(0, 120, 2):
        n = int(rng.choice([0, 1, 5, 300, 3000]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.7, 0.85, 1.0])], rng.integers(0, 2**63, n // 8, dtype=np.uint64)]))
        sets += [(k, len(a), bytearray(simhash.bins(a))), (k + 1, len(b), bytearray(simhash.bins(b)))]
        pairs.append((k, k + 1, bool(simhash.is_similar(len(np.intersect1d(a, b)), len(a), len(b)))))
    table = spark.createDataFrame(sets, "node long, size long, bins binary")
    kept = {r["a"] for r in simhash._possible(spark.createDataFrame([p[:2] for p in pairs], "a long, b long"), table).collect()}
    similar = {a for a, _, s in pairs if s}
    assert similar <= kept and len(similar) > 10 and len(kept) < len(similar) + 6


def test_groups_of_both_links(make, monkeypatch):
    """With fingerprints: the components of all pairs that are within 3 bits or similar."""
    rng = random.Random(3)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 4, 30, 200]))]
        texts += [words, [*words, "more"], mutated(words, 0.02, rng), mutated(words, 0.3, rng)]
    prints = [simhash.simhash(simhash.shingle_hashes(" ".join(w).encode())) for w in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if (jaccard(a, b) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 3) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    docs = make([(k, " ".join(w)) for k, w in enumerate(texts)])
    assert sorted(r["doc_id"] for r in simhash.similar_dedup(docs, prints=True).collect()) == sorted(set(root))
    assert simhash.similar_dedup(make([(3, None), (2, ""), (None, " ")]), prints=True).collect()[0]["doc_id"] == 2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# suffix arrays


@pytest.mark.parametrize(("bucket", "words"), [(0, 4), (10**9, 4), (0, 0), (10**9, 1)])
@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcde"])
def test_suffix_array(alphabet, bucket, words, monkeypatch):
    monkeypatch.setattr(suffix_array, "BUCKET", bucket)
    monkeypatch.setattr(suffix_array, "WORDS", words)
    monkeypatch.setattr(suffix_array, "SHORT", 1)
    rng = random.Random(len(alphabet))
    for _ in range(400):
        data = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 70)))
        order = suffix_array.suffix_array(np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1, [0]]))
        assert order.tolist() == sorted(range(len(data) + 1), key=lambda i: data[i:])
        previous, shared = suffix_array.permuted_prefixes(data, order)
        some = np.arange(0, len(data), 3)
        before, part = suffix_array.permuted_prefixes(data, order, some)
        assert (before == previous[some]).all() and (part == shared[some]).all()
        for k in range(2, len(order)):
            i, j = int(order[k]), int(order[k - 1])
            m = 0
            while max(i, j) + m < len(data) and data[i + m] == data[j + m]:
                m += 1
            assert (previous[i], shared[i]) == (j, m)


def test_suffix_array_of_a_longer_text(documents):
    data = " ".join(r["text"] for r in documents.limit(8).collect()).encode()[:6000]
    order = suffix_array.suffix_array(np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1, [0]]))
    assert order.tolist() == sorted(range(len(data) + 1), key=lambda i: data[i:])


def brute_repeats(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                hit[k : k + length] = True
        first, _ = suffix_dedup.runs(hit)
        out.append((len(t), int(hit.sum()), len(first), hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


def passages(seed):
    """Texts that share passages just under and over the length, within and across texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: "".join(word() for _ in range(n))
    shared = [prose(rng.randint(25, 70)) for _ in range(12)]
    out = []
    for _ in range(60):
        parts = [prose(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            parts += [s[a : len(s) - rng.randint(0, 20)], prose(rng.randint(0, 30))]
        out.append("".join(parts))
    return [*out, out[0], out[0], "ab" * 400, "x" * 700, "short", "", "é" * 150, "é" * 99]


@pytest.mark.parametrize(("length", "gram", "wide"), [(200, 72, 1_000), (200, 72, 1), (60, 20, 3), (60, 20, 1_000)])
def test_repeats_equal_brute_force(make, length, gram, wide):
    texts = passages(length + wide)
    docs = make(list(enumerate(texts)))
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length=length, gram=gram, wide=wide)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in out] == brute_repeats([t.encode() for t in texts], length)


def test_a_shard_of_ten_times_what_a_suffix_array_takes(make, monkeypatch):
    """A passage that all texts share, with few and many bytes around it that differ, and some that agree."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ij") for _ in range(260))
    side = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [side(rng.randint(0, 40), "xy") + passage[rng.randint(0, 40) : 260 - rng.randint(0, 40)] + side(rng.randint(0, 40), "pq") + side(30, "mnop") for _ in range(1200)]
    levels = []
    old = suffix_dedup._cores
    monkeypatch.setattr(suffix_dedup, "_cores", lambda width, *a: (levels.append(width), old(width, *a))[1])
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(make(list(enumerate(texts))), wide=10)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in out] == brute_repeats([t.encode() for t in texts], 200)
    assert levels == [16, 4, 1]


def test_texts_that_share_a_hash_are_told_apart(make, monkeypatch):
    """With hashes of few values the seed is drawn anew until no two texts share one."""
    from pyspark.sql import functions as F

    real, calls = F.xxhash64, []
    texts = passages(1)[:6]
    docs = make(list(enumerate(texts)))
    monkeypatch.setattr(suffix_dedup.F, "xxhash64", lambda *c: (calls.append(1), real(*c) % 64)[1])
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).orderBy("doc_id").collect()
    monkeypatch.undo()
    assert [tuple(r)[1:] for r in out] == brute_repeats([t.encode() for t in texts], 200) and len(calls) > 2


def test_repeats_of_long_texts(monkeypatch, make):
    texts = passages(3)
    body = "".join(texts[:40]) + "y" * 300 + "".join(texts[20:30])
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    whole = suffix_dedup.contexts(body.encode())
    assert int((whole[2] - whole[1] + 1).sum()) == len(body.encode()) - 199
    monkeypatch.undo()
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(make([(1, body), (2, "q" + body[5000:9000])]))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in out] == brute_repeats([body.encode(), ("q" + body[5000:9000]).encode()], 200)


def test_repeats_odd(odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(odd)).collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["n_bytes"]): r for r in out}
    size = len(next(r["text"] for r in rows if r["doc_id"] == 4).encode())
    assert by[4, size]["n_removed"] == by[5, size]["n_removed"] == size
    assert by[9, 5000]["n_removed"] == 5000 and by[9, 5000]["n_spans"] == 1
    assert by[1, 0]["n_spans"] == 0 and by[1, 0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup.remove_repeats(nothing).count() == 0


# line templates


def test_templates(make):
    rows = [(k, f"Page {k} of 30 printed\nUser anna logged in from host-{k}\nAll rights reserved by us\nSomething unique to text {'abcdefgh'[k]} here") for k in range(8)]
    rows += [(20 + k, f"All {w} {v} stand alone" * 1) for k, (w, v) in enumerate([("my", "cats"), ("my", "dogs"), ("your", "cats")])]
    out = {r["doc_id"]: r for r in line_template.drop_lines(make(rows)).collect()}
    assert all(out[k]["text"] == "" and out[k]["n_dropped"] == 4 for k in range(8))  # the fourth differs in one field
    assert all(out[k]["n_dropped"] == 0 for k in (20, 21, 22))


def test_a_line_that_repeats_in_one_document_stays(make):
    out = line_template.drop_lines(make([(1, "the same old line\n" * 20), (2, "another text")])).collect()
    assert {r["n_dropped"] for r in out} == {0}


def test_lines_odd(odd, nothing):
    out = line_template.drop_lines(odd)
    assert out.count() == odd.count()
    assert {(r["n_lines"], r["text"]) for r in out.where("doc_id = 1").collect()} == {(1, "")}
    assert {r["text"] for r in out.where("doc_id = 3").collect()} == {"  \n\t "}
    assert line_template.drop_lines(nothing).count() == 0


def test_native_operators_run_no_python(documents):
    for out in (exact_dedup.exact_dedup(documents), line_template.drop_lines(documents)):
        plan = out._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|InArrow", plan)


def test_lookup_splits_hot_keys(spark):
    from tidelog.llm import common

    rows = spark.range(20_000).select(F.when(F.col("id") < 7000, F.lit(-1)).otherwise(F.col("id") % 3000).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = common.lookup(rows, table, ["k"], "n", 20_000)
    assert out.columns == ["k", "id", "n"]
    assert out.count() == 20_000 and out.where("k = -1").agg(F.min("n"), F.max("n")).first()[:] == (7000, 7000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put small partitions together
    try:
        dealt = common.lookup(rows, table, ["k"], "n", 20_000).where("k = -1").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dealt > 1
