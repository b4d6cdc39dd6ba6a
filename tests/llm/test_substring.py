import random

import numpy as np

from parley.llm import blocks
from parley.llm.substring import dedup_substrings, window_hashes


def brute(docs, span):
    first = {}
    texts = [(i if i is not None else -10**18, (t or "").encode().split()) for i, t in docs]
    for i, w in texts:
        for s in range(len(w) - span + 1):
            k = tuple(w[s:s + span])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (ident, _), (i, w) in zip(docs, texts):
        gone = set()
        for s in range(len(w) - span + 1):
            if first[tuple(w[s:s + span])] < (i, s):
                gone |= set(range(s, s + span))
        out.append((ident, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def result(df, span):
    return sorted(map(tuple, dedup_substrings(df, span).select("doc_id", "n_words", "n_removed", "text").collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    passages = [[f"p{rnd.randrange(50)}" for _ in range(rnd.randrange(4, 60))] for _ in range(6)]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rnd.randrange(5)):
            w += rnd.choice(passages) if rnd.random() < 0.5 else [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))]
        docs.append((1000 - 7 * i, rnd.choice([" ", "\t", "  "]).join(w)))
    docs += [(5000 + i, docs[3][1]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for span in (1, 3, 20):
        assert result(df, span) == sorted(brute(docs, span), key=str)


def test_edges(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(40000))
    docs = [(1, None), (2, ""), (3, "a b"), (4, " ".join("ab" * 30)), (5, long), (6, long), (7, "é x " * 30), (7, "é x " * 30), (None, " ".join("ab" * 30))]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, block string")
    assert result(df, 20) == sorted(brute(docs, 20), key=str)
    assert dedup_substrings(df.limit(0)).count() == 0


def test_packing_round_trip():
    for values in ([], [0], [5, 5, 5], [1, 2, 2**63, 2**64 - 1], list(range(0, 10**6, 7))):
        a = np.array(values, np.uint64)
        assert (blocks.unpack(blocks.pack(a)) == a).all() and (blocks.unpack_sorted(blocks.pack_sorted(a)) == a).all()


def test_order_of_pairs():
    rng = np.random.default_rng(2)
    for bits, top in ((40, 40), (40, 8), (8, 64), (40, 60)):
        high = rng.integers(0, 2**top, 3000, dtype=np.uint64) if top < 64 else rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
        high = np.concatenate((high, high[:1000], np.full(500, high[0])))
        low = rng.integers(0, 2**bits, len(high)).astype(np.uint64)
        low[3000:3500] = low[:500]
        order = blocks.order_pairs(high, low, bits)
        want = np.lexsort((low, high))
        assert (high[order] == high[want]).all() and (low[order] == low[want]).all()
    assert len(blocks.order_pairs(high[:0], low[:0], 40)) == 0


def test_window_hash_depends_on_the_words_only():
    w = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    for span in (1, 2, 7, 20):
        h = window_hashes(w, span, 0x9E3779B97F4A7C15)
        seen = {}
        assert len(h) == len(w) - span + 1
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(tuple(w[i:i + span].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)
