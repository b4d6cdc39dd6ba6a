import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parley.llm.toxicity import BlockMaxIndex, critical_value, isotonic, score_toxicity
from tests.conftest import SF01


def csr(vectors):
    ptr = np.concatenate(([0], np.cumsum([len(v[0]) for v in vectors])))
    return ptr, np.concatenate([v[0] for v in vectors]).astype(np.int64), np.concatenate([v[1] for v in vectors])


@pytest.mark.parametrize("k", [1, 10, 700])
def test_nearest_is_exact(k):
    rng = np.random.default_rng(3)
    m = 50
    vectors = []
    for _ in range(500):
        ids = np.unique(rng.integers(0, m, rng.integers(0, 8)))
        w = rng.random(len(ids)) + 0.01
        vectors.append((ids, w / np.linalg.norm(w) if len(w) else w))
    vectors += vectors[:30] * 3  # ties
    dense = np.zeros((len(vectors), m))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    want = np.rint(dense @ dense.T * 10**9) / 10**9
    for skip in (None, np.arange(len(vectors))):
        best, cos = BlockMaxIndex(vectors, m).nearest(*csr(vectors), k, skip)
        for q in range(len(vectors)):
            near = want[q].copy()
            if skip is not None:
                near[q] = 0
            order = [i for i in np.lexsort((np.arange(len(near)), -near))[:k] if near[i] > 0]
            assert best[q, :len(order)].tolist() == order and (best[q, len(order):] == -1).all()
            assert np.allclose(cos[q, :len(order)], near[order])


def test_blocks_are_skipped():
    """Like examples share blocks, and blocks below the bound are not scored."""
    vectors = [(np.array([i // 64, 90]), np.array([0.9, 0.1])) for i in range(64 * 40)]
    index, scored = BlockMaxIndex(vectors, 91), []
    plain = index._score
    index._score = lambda *a: scored.append(len(a[3])) or plain(*a)
    best, _ = index.nearest(*csr([(np.array([7, 90]), np.array([0.9, 0.1]))]), 15)
    assert best[0].tolist() == list(range(7 * 64, 7 * 64 + 15)) and sum(scored) <= 4


def test_isotonic():
    x = np.array([1, 2, 3, 4, 5, 6.0])
    knots, values = isotonic(x, np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6))
    assert np.all(np.diff(values) >= 0) and np.isclose(np.interp(2.5, knots, values), 0.5) and np.isclose(np.interp(9, knots, values), 2 / 3)


def test_critical_value():
    assert abs(critical_value(0.05) - 3.8415) < 1e-3 and abs(critical_value(1e-8) - 32.84) < 1e-2


def brute(docs, labels, error=0.01, effect=0.01, k=15, smooth=0.25):
    """The whole score from its definition, with dense vectors."""
    words = lambda t: [w for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]
    text = dict(docs)
    lab = {}
    for i, t in labels:
        if i in text and t is not None and zlib.crc32(str(i).encode()) % 5 != 0:
            lab[i] = max(lab.get(i, 0), int(t > 0))
    ids = sorted(lab)
    y = np.array([lab[i] for i in ids], float)
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    held = [set(words(text[i])) for i in ids]
    counts = {w: [sum(w in h for h, v in zip(held, y) if v == c) for c in (0, 1)] for w in set().union(*held)}
    least = critical_value(error / len(counts))

    def chi(a, b):
        below = (a + b) * (n0 + n1 - a - b) * n0 * n1
        return (n0 + n1) * (b * (n0 - a) - a * (n1 - b)) ** 2 / below if below else 0

    terms = sorted(w for w, (a, b) in counts.items() if chi(a, b) > least and chi(a, b) >= effect * (n0 + n1))
    n = len(docs)
    df = Counter(w for _, t in docs for w in set(words(t)))
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in terms}

    def vector(t):
        c = Counter(words(t))
        v = np.array([(1 + math.log(c[w])) * idf[w] if c[w] else 0.0 for w in terms])
        return v / (np.linalg.norm(v) or 1)

    ex = np.array([vector(text[i]) for i in ids])
    prior = n1 / (n0 + n1)

    def vote(t, skip=None):
        cos = np.rint(ex @ vector(t) * 10**9) / 10**9
        if skip is not None:
            cos[skip] = 0
        best = [e for e in np.lexsort((np.arange(len(ids)), -cos))[:k] if cos[e] > 0]
        return (sum(cos[e] * y[e] for e in best) + smooth * prior) / (sum(cos[e] for e in best) + smooth)

    x = np.array([vote(text[i], e) for e, i in enumerate(ids)])
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    # isotonic regression as max of min of means (equal votes are one point)
    points = sorted(set(xs))
    group = [ys[xs == p] for p in points]
    mean = lambda a, b: sum(map(sum, group[a:b + 1])) / sum(map(len, group[a:b + 1]))
    fit = [max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
    return {i: float(np.interp(vote(t), points, fit)) for i, t in docs}, terms


def test_whole_score_against_brute_force(spark):
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(220):
        toxic = i % 4 == 0
        words = [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(3, 30))]
        words += rnd.choices(["Awful", "vile", "bad"], k=rnd.randrange(1, 4)) if toxic and rnd.random() < 0.9 else ["kind"] * rnd.randrange(3)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic) if rnd.random() < 0.95 else int(not toxic)))
    want, terms = brute(docs, labels)
    assert b"awful" in terms
    got = score_toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and len({round(s, 6) for s in want.values()}) >= 5
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) >= 0.9


def test_edges(spark):
    rnd = random.Random(1)
    word = lambda: f"w{rnd.randrange(40)}"
    docs = [(i, " ".join([word() for _ in range(20)] + ["awful"] * (i % 4 == 0))) for i in range(200)] + [(300, None), (301, ""), (None, "awful"), (302, "awful " + "w1 " * 50000), (303, "awful"), (303, "awful"), (304, "z" * 100_000)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(0, 0, None), (999, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_toxicity(d, lab).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[303].predicted == 1 and by[None].predicted == 1 and by[300].predicted == by[301].predicted == by[304].predicted == 0
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 200) > 190
    assert score_toxicity(d.limit(0), lab).count() == 0
    assert {r.score for r in score_toxicity(d, lab.limit(0)).collect()} == {0.0}
