import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm.trie_lm import PRIOR_TOKENS, EliasFano, Trie, decode, encode, score_documents
from tests.conftest import SF001, SF01


def words(t):
    return (t or "").encode().lower().decode().split() + [None]


def test_elias_fano_round_trip_and_successor_search():
    rng = np.random.default_rng(0)
    for values in ([], [0], [7], [0, 0, 0, 5], sorted(rng.integers(0, 2**40, 20000).tolist()), list(range(9000)), [2**62]):
        a = np.array(values, np.uint64)
        ef = EliasFano(a)
        assert (ef.get(np.arange(len(a))) == a).all()
        distinct = np.unique(a)
        ef = EliasFano(distinct)
        asked = np.unique(np.concatenate((distinct, distinct + np.uint64(1), np.array([3], np.uint64))))
        place = {int(v): i for i, v in enumerate(distinct.tolist())}
        assert ef.find(asked).tolist() == [place.get(int(v), -1) for v in asked.tolist()]
    assert len(EliasFano(np.arange(0, 10**6, 10)).low) + len(EliasFano(np.arange(0, 10**6, 10)).high) < 10**5


def test_codes_never_gain_mass():
    p = np.random.default_rng(1).random(1000)
    back = decode(encode(p))
    assert (back <= p * (1 + 1e-9)).all() and (back > p * 0.999).all()
    assert decode(encode(np.zeros(2))).tolist() == [0, 0]


def test_trie_against_counting(tmp_path):
    rnd = random.Random(4)
    grams = Counter((rnd.choice([0, 2, 4, 5, 7, 8]), rnd.randrange(5), rnd.randrange(30)) for _ in range(600))
    keys = sorted(grams)
    root, prev, nxt = (np.array([k[i] for k in keys], np.uint64) for i in range(3))
    trie = Trie(root, prev, nxt, np.array([grams[k] for k in keys], float)).map_to(str(tmp_path))
    asked = sorted({(r, u, w) for r in range(10) for u in range(6) for w in range(32)})
    a, b = trie.masses(*(np.array([k[i] for k in asked], np.uint64) for i in range(3)))
    for (r, u, w), x, y in zip(asked, a, b):
        c3, c2 = Counter(), Counter()
        for (r2, u2, w2), n in grams.items():
            if r2 == r:
                c2[w2] += n
                if u2 == u:
                    c3[w2] += n
        t2, t3 = sum(c2.values()), sum(c3.values())
        g2, m2 = PRIOR_TOKENS / (t2 + PRIOR_TOKENS), c2[w] / (t2 + PRIOR_TOKENS)
        if r % 2:  # split: its bigrams are asked elsewhere
            g2, m2 = 1, 0
        g3, m3 = (0.75 * len(c3) / t3, max(c3[w] - 0.75, 0) / t3) if t3 else (1, 0)
        assert x == pytest.approx(m3 + g3 * m2, rel=3e-3, abs=1e-9) and y == pytest.approx(g3 * g2, rel=3e-3)
        assert x <= m3 + g3 * m2 + 1e-12


def corpus(n=300, seed=2):
    rnd = random.Random(seed)
    vocab = [f"{rnd.choice('wWéÉ')}{i}" for i in range(200)] + ["The", "the", "THE"] * 40
    docs = []
    for i in range(n):
        if docs and rnd.random() < 0.3:
            docs.append((i, rnd.choice(docs)[1]))
        else:
            docs.append((i, " ".join(rnd.choices(vocab, k=rnd.randrange(1, 60)))))
    return docs


def test_base_score_and_gain(spark):
    docs = corpus()
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    got = score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        tokens = words(text[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # copies are foreseen


def brute_scores(docs):
    """The model of the module's docstring over dictionaries."""
    c1, c2, c3 = Counter(), defaultdict(Counter), defaultdict(Counter)
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            s = ["<s>", "<s>", *words(t)]
            for u, v, w in zip(s, s[1:], s[2:]):
                c1[w] += 1
                c2[v][w] += 1
                c3[u, v][w] += 1
    n, v1 = sum(c1.values()), len(c1)

    def p(u, v, w):
        p1 = (c1[w] + 0.5) / (n + 0.5 * (v1 + 1))
        p2 = (c2[v][w] + PRIOR_TOKENS * p1) / (sum(c2[v].values()) + PRIOR_TOKENS)
        c, total = c3[u, v], sum(c3[u, v].values())
        return max(c[w] - 0.75, 0) / total + 0.75 * sum(x > 0 for x in c.values()) / total * p2 if total else p2

    return {i: sum(math.log10(p(*g)) for g in zip(s, s[1:], s[2:])) for i, t in docs for s in [["<s>", "<s>", *words(t)]]}


@pytest.mark.parametrize("hot_tokens", [10**6, 100, 5])
def test_scores_against_brute_force(spark, hot_tokens):
    """Also with frequent (100) and nearly all (5) middle words split."""
    docs = corpus(120, seed=9)
    want = brute_scores(docs)
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string"), hot_tokens=hot_tokens).collect()}
    assert got == pytest.approx(want, rel=5e-3)
    assert all(got[i] <= want[i] + 1e-6 for i in want)  # codes are rounded down


def test_base_score_of_the_given_documents(spark):
    """The contract's formula, from its own text, on all sf0.01 documents."""
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for i, t in docs}
    c = Counter(w for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for r in score_documents(df).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel=1e-9)


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    held, runs = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 24):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            runs.append({r.doc_id: r.score for r in score_documents(df, hot_tokens=500).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert runs[0] == pytest.approx(runs[1], rel=1e-9)


def test_edges(spark):
    docs = [(1, None, "k"), (2, "", "k"), (3, "a " * 50000, "k"), (3, "a " * 50000, "k"), (None, "é a", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, held_out string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in score_documents(df).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (3, 50001), (3, 50001)]
    assert score_documents(df.limit(0)).count() == 0
