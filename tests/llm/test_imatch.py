import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from parley.llm.imatch import FIRST_RATE, LEVELS, SLOTS, fingerprint_edits


def edited(a, b):
    a, b = a or "", b or ""
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def text(rnd, n):
    return " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.choice([2, 3, 4]))) for _ in range(n))


def test_edits_and_likeness(spark):
    rnd = random.Random(1)
    docs = [(10 * i, text(rnd, rnd.choice([1, 5, 100, 400, 2000]))) for i in range(120)]
    docs[7] = (70, docs[3][1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint_edits(df, min_share=0.0, max_share=0.6, ranges=7).collect()}
    assert len(got) == len(docs)
    near, far = [], []
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        r, e = got[i], edited(t, nxt)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if len(t) > 200:
            near.append(r.near_edited), far.append(r.near_next)
        if e == t:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
    assert got[70].fingerprint == got[30].fingerprint
    assert sum(near) / len(near) > 2 * sum(far) / len(far)
    # the number of ranges and the order of rows do not matter
    again = {r.doc_id: r for r in fingerprint_edits(df.orderBy("text"), min_share=0.0, max_share=0.6, ranges=1).collect()}
    assert again == got


def test_edges(spark):
    schema = "doc_id long, text string, range string"
    docs = [(1, None, "z"), (2, "", "z"), (3, "one two three", "z"), (3, "one two three", "z"), (None, "x " * 50000, "z"), (9, "!!! ???", "z")]
    rows = fingerprint_edits(spark.createDataFrame(docs, schema)).collect()
    got = sorted(((r.doc_id or 0), r.n_chars) for r in rows)
    assert got == [(0, 100000), (1, 0), (2, 0), (3, 13), (3, 13), (9, 7)]
    assert len({r.fingerprint for r in rows if r.doc_id == 3}) == 1
    one = fingerprint_edits(spark.createDataFrame(docs[2:3], schema)).collect()[0]
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(edited("one two three", "one two three").encode()).hexdigest()
    assert fingerprint_edits(spark.createDataFrame(docs[:0], schema)).count() == 0
    assert pytest.approx(1.0) == fingerprint_edits(spark.createDataFrame([(1, "same words"), (2, "same words")], "doc_id long, text string")).collect()[0].near_next


def chained(values):
    """Spark's xxhash64 of several longs (or 4-byte ints): each hash is the next seed."""
    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest((v % 2 ** (8 * size)).to_bytes(size, "little"), h)
    return h


def brute_fingerprints(docs, min_share, max_share):
    """(fingerprint, edited_fingerprint, near_edited, near_next) by definition."""
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w]
    term = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    df = Counter(w for _, t in docs for w in set(words(t)))
    subsets = {}
    for w, n in df.items():
        if min_share * len(docs) <= n <= max_share * len(docs):
            for i in range(LEVELS):
                level = chained([(term(w), 8), (i, 4)])
                level = (level - 2**64 if level >= 2**63 else level) % (FIRST_RATE << i)
                if level < SLOTS:
                    subsets.setdefault(w, []).append(level + SLOTS * i)

    def components(t):
        held = {}
        for w in set(words(t)):
            for k in subsets.get(w, ()):
                held.setdefault(k, []).append(term(w))
        signed = lambda h: h - 2**64 if h >= 2**63 else h
        return {k: chained([(h, 8) for h in sorted(map(signed, hs))]) for k, hs in held.items()}

    def plain(t):
        h = 42
        for w in words(t):
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return f"text:{h:016x}"

    show = lambda t: " ".join(sorted(f"{k:02X}:{c >> 32:08x}" for k, c in components(t).items())) or plain(t)

    def like(a, b):
        x, y = components(a), components(b)
        return sum(x.get(k) == c for k, c in y.items()) / len({*x, *y}) if x or y else float(plain(a) == plain(b))

    out = {}
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        e = edited(t, nxt)
        out[i] = (show(t), show(e), like(t, e), like(t, nxt))
    return out


def test_fingerprints_against_brute_force(spark):
    rnd = random.Random(6)
    docs = [(i, text(rnd, rnd.choice([0, 1, 3, 50, 300, 1500]))) for i in range(80)]
    docs[40] = (40, docs[39][1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for shares in ((0.0, 0.6), (0.05, 0.3)):
        want = brute_fingerprints(docs, *shares)
        got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprint_edits(df, *shares).collect()}
        assert got.keys() == want.keys()
        for i, w in want.items():
            assert got[i][:2] == w[:2] and got[i][2:] == pytest.approx(w[2:]), i
