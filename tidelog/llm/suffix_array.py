"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. The leftmost S of each run (LMS) begins an LMS substring; these are sorted by inducing, named, and, where names repeat, sorted by a recursive call on the string of names. From the sorted LMS suffixes one scan from the left puts every L suffix in place and one from the right every S suffix, each in linear time.
"""

from __future__ import annotations

import numpy as np

#: Strings up to this length, as the recursion ends in, are sorted outright.
SHORT = 100
#: Values that a bucket holds on average, at least, where buckets are induced from as a whole; smaller ones are induced from value by value.
BUCKET = 100
#: Machine words that hold an LMS substring of names, at most, where these are sorted by number.
WORDS = 4


def classify(s: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next; s ends in its unique smallest value."""
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(len(step)), len(step))
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal values ends
    return np.concatenate([step[at] > 0, [True]])


def _induce(values: list[int], before_l: list[int], before_s: list[int], counts: np.ndarray, lms: list[int]) -> list[int]:
    """All suffixes in order, from LMS suffixes in order; from LMS positions in any order, LMS substrings in order."""
    ends = np.cumsum(counts)
    tail = ends.tolist()
    out = [-1] * len(values)
    for j in reversed(lms):
        c = values[j]
        tail[c] -= 1
        out[tail[c]] = j
    head = (ends - counts).tolist()
    for j in out:  # grows while it is read
        if j >= 0:
            k = before_l[j]
            if k >= 0:
                c = values[k]
                out[head[c]] = k
                head[c] += 1
    tail = ends.tolist()
    for i in range(len(out) - 1, -1, -1):
        k = before_s[out[i]]
        if k >= 0:
            c = values[k]
            tail[c] -= 1
            out[tail[c]] = k
    return out


def _induce_buckets(s: np.ndarray, before_l: np.ndarray, before_s: np.ndarray, counts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same as _induce, a bucket at a time: what a bucket's suffixes induce goes to the buckets of other values in one step, and to its own in further ones."""
    ends = np.cumsum(counts)
    begins = ends - counts
    out = np.empty(len(s), np.int64)
    place = np.arange(len(s))
    used = np.flatnonzero(counts)
    firsts = s[lms]
    seeds = lms[np.argsort(firsts, kind="stable")]
    upto = np.cumsum(np.bincount(firsts, minlength=len(counts)))

    def grouped(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        values = s[k]
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        n = np.empty(len(first), np.int64)
        n[:-1], n[-1] = first[1:] - first[:-1], len(k) - first[-1]
        return k[order], values[first], first, n

    head = begins.copy()

    def ahead(k: np.ndarray) -> None:
        k = k[k >= 0]
        if len(k):
            k, value, first, n = grouped(k)
            out[np.repeat(head[value] - first, n) + place[: len(k)]] = k
            head[value] += n

    for c in used.tolist():
        done = begins[c]
        while done < head[c]:
            done, part = head[c], out[done : head[c]]
            ahead(before_l[part])
        ahead(before_l[seeds[upto[c - 1] if c else 0 : upto[c]]])
    tail = ends.copy()

    def back(k: np.ndarray) -> None:
        k = k[k >= 0]
        if len(k):
            k, value, first, n = grouped(k)
            out[np.repeat(tail[value] + first - 1, n) - place[: len(k)]] = k
            tail[value] -= n

    for c in used[::-1].tolist():
        done = ends[c]
        while done > tail[c]:
            done, part = tail[c], out[tail[c] : done]
            back(before_s[part[::-1]])
        back(before_s[out[begins[c] : head[c]][::-1]])
    out[0] = len(s) - 1  # nothing stands behind the unique smallest value
    return out


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each LMS substring, in the order of the sorted ones; equal substrings share one."""
    end = np.concatenate([lms[1:], lms[-1:]])
    length = np.zeros(len(s), np.int64)
    length[lms] = end - lms
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    same &= length[a] > 0
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        live = live[equal & (k < length[a[live]])]
        k += 1
    names = np.concatenate([[0], np.cumsum(~same)])
    return names, int(names[-1]) + 1


def _packed(s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """LMS positions in the order of their substrings, and the substrings' names, from numbers that hold their values; None if they are too long for that.

    A substring ends with the next LMS. If it is the beginning of another one, that one goes on with an L there, which is smaller than the S of the same value; so what stands behind a substring's end counts as larger than all values.
    """
    length = np.concatenate([lms[1:], lms[-1:]]) - lms + 1
    most, behind = int(length.max()), int(s.max()) + 1
    bits = behind.bit_length()
    each = 63 // bits
    words = -(-most // each)
    if words > WORDS:
        return None
    at = lms[:, None] + np.arange(words * each)
    values = np.where(np.arange(words * each) < length[:, None], s[np.minimum(at, len(s) - 1)], behind)
    keys = values.reshape(len(lms), words, each) @ (np.int64(1) << (bits * np.arange(each - 1, -1, -1, dtype=np.int64)))
    order = np.lexsort(keys.T[::-1]) if words > 1 else np.argsort(keys[:, 0], kind="stable")
    keys = keys[order]
    return lms[order], np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])


def suffix_array(s: np.ndarray, depth: int = 0) -> np.ndarray:
    """The starts of the suffixes of s in order. s holds integers from 0 on and ends in its only 0.

    LMS substrings of the text are sorted by inducing. Those of the names that the recursion sorts are few and short; where numbers hold them, these are sorted instead.
    """
    n = len(s)
    if n <= SHORT:
        whole = s.tolist()
        return np.array(sorted(range(n), key=lambda i: whole[i:]), np.int64)
    small = classify(s)
    is_lms = np.concatenate([[False], small[1:] & ~small[:-1]])
    lms = np.flatnonzero(is_lms)
    counts = np.bincount(s)
    place = np.arange(-1, n - 1)
    before_l = np.concatenate([[-1], np.where(small[:-1], -1, place[1:])])
    before_s = np.concatenate([[-1], np.where(small[:-1], place[1:], -1)])
    if n >= BUCKET * np.count_nonzero(counts):
        induce = lambda order: _induce_buckets(s, before_l, before_s, counts, order)
    else:
        lists = s.tolist(), before_l.tolist(), before_s.tolist()
        induce = lambda order: np.array(_induce(*lists, counts, order.tolist()), np.int64)
    found = _packed(s, lms) if depth else None
    if found is None:
        rough = induce(lms)
        order = rough[is_lms[rough]]
        names, different = _names(s, lms, order)
    else:
        order, names = found
        different = int(names[-1]) + 1
    if different < len(lms):
        named = np.zeros(n, np.int64)
        named[order] = names
        order = lms[suffix_array(named[lms], depth + 1)]
    return induce(order)


def permuted_prefixes(data: bytes, order: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending starts (by default all), the start that precedes it in the suffix array (-1 for the first), and the length of the prefix that both share.

    Computed in text order, where the length falls by one at most from one start to the next, so over a run of starts all comparisons are linear. data is the text without its final value; shared prefixes end at its end.
    """
    n = len(data)
    inner = order[order < n]
    previous = np.full(n, -1, np.int64)
    previous[inner[1:]] = inner[:-1]
    if starts is None:
        starts = np.arange(n)
    out, shared, at = [0] * len(starts), 0, -1
    for k, (i, j) in enumerate(zip(starts.tolist(), previous[starts].tolist(), strict=True)):
        if i != at + 1:
            shared = 0
        at = i
        if j < 0:
            shared = 0
            continue
        most = n - (i if i > j else j)
        while shared < most and data[i + shared] == data[j + shared]:
            stop = shared + 32
            if stop <= most and data[i + shared : i + stop] == data[j + shared : j + stop]:
                shared = stop
            else:
                shared += 1
        out[k] = shared
        if shared:
            shared -= 1
    return previous[starts], np.array(out, np.int64)
