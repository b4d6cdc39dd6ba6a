import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm.kneser_ney import BEGIN, Grams, Model, count_grams, gram_keys, judge, keep_good
from tests.conftest import SF01

TEXTS = ["abab cab", "aab b", "cab", "é?", "", "abcabcabc abc", "日本語日本", "привет мир привет"]


def ngrams(text, order):
    s = [BEGIN] * (order - 1) + [ord(c) for c in text or ""]
    return [tuple(s[i:i + order]) for i in range(len(s) - order + 1)]


def brute(trained, order):
    """Interpolated modified Kneser-Ney by recursion over dictionaries."""
    counts = {order: Counter(g for t in trained for g in ngrams(t, order))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    context, d_of = {n: defaultdict(list) for n in counts}, {}
    for n, table in counts.items():
        for g, c in table.items():
            context[n][g[:-1]].append(c)
        n1, n2, n3, n4 = (sum(c == i for c in table.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d_of[n] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        d = lambda c: d_of[n][min(c, 3) - 1]
        lower, cs = p(g[1:]), context[n].get(g[:-1])
        if not cs:
            return lower
        c = counts[n].get(g, 0)
        return (max(c - d(c), 0) if c else 0) / sum(cs) + sum(map(d, cs)) / sum(cs) * lower

    return p


def test_grams_of_texts():
    for order in (2, 3, 4):
        grams = Grams([*TEXTS, None], order)
        listed = [tuple(x) for x in np.stack(grams.columns(order), 1)]
        assert [listed[i] for i in grams.of] == [g for t in TEXTS for g in ngrams(t, order)]
        assert grams.lengths.tolist() == [len(t) for t in TEXTS] + [0]
        for n in range(1, order):
            longer, shorter = (np.stack(grams.columns(m), 1) for m in (n + 1, n))
            assert (longer[:, :-1] == shorter[grams.prefix[n]]).all() and (longer[:, 1:] == shorter[grams.suffix[n]]).all()
            assert (gram_keys(grams.columns(n)) == grams.keys()[n - 1]).all()
        # they do not depend on the order of the texts
        keys = lambda texts: [sorted(k.tolist()) for k in Grams(texts, order).keys()]
        assert keys(TEXTS) == keys(TEXTS[::-1])
    assert len(Grams([], 3).of) == len(Grams([None, ""], 3).of) == 0


def test_counts(spark):
    got = count_grams(spark.createDataFrame([(t,) for t in TEXTS], "text string"), 3, chunk=3)
    assert {tuple(r)[:3]: r.c for r in got.collect()} == Counter(g for t in TEXTS for g in ngrams(t, 3))


@pytest.mark.parametrize("order", [2, 4])
def test_perplexity_against_brute_force(spark, order):
    """Sharded masses and lefts give the recursion's probabilities, also of
    texts, characters and scripts that the model has never seen."""
    texts = dict(enumerate(TEXTS * 3 + ["unseen 문자 text", None, "ab" * 500]))
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, c0 int").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(len(TEXTS) * 3)], "doc_id long, quality int")
    fit = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)) == 0)
    p = brute([texts[r.doc_id] for r in fit.collect()], order)
    got = Model(docs, labels, 1000, order).add(docs, ["doc_id", "c0"]).collect()
    assert len(got) == len(texts)
    for r in got:
        want = [math.log10(p(g)) for g in ngrams(texts[r.c0], order)]
        assert r.kn_n == len(want) and r.kn_logp == pytest.approx(sum(want), rel=1e-3, abs=1e-3)


def test_junk_in_every_script_is_rejected(spark):
    """One alphabet for Latin, Cyrillic and Han: bad text is seen in each."""
    import random
    rnd = random.Random(4)
    words = {"en": "the cat sat on a mat and saw it run".split(), "ru": "кот сидел на окне и смотрел вниз".split(), "zh": "我 们 今天 去 学校 看 书 写 字".split()}
    docs, labels = [], []
    for i in range(600):
        lang = ("en", "ru", "zh")[i % 3]
        good = i % 10 != 0
        text = " ".join(rnd.choices(words[lang], k=60))
        if not good:
            text = "".join(rnd.sample(text, len(text)))
        docs.append((i, text, lang))
        if i < 300:
            labels.append((i, int(good)))
    kept = {r.doc_id for r in keep_good(spark.createDataFrame(docs, "doc_id long, text string, lang string"),
                                        spark.createDataFrame(labels, "doc_id long, quality int"), min_trusted=20).collect()}
    assert not any(i in kept for i in range(0, 600, 10))
    assert sum(i in kept for i in range(600) if i % 10) > 500


def test_labels_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = judge(docs, labels).join(labels, "doc_id").collect()
    good = [r.kn_keep for r in rows if r.quality == 1]
    bad = [r.kn_keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.5


def test_edges(spark):
    docs = [(i, "the cat sat on the mat", "en") for i in range(60)] + [(100, None, "en"), (101, "", None), (None, "the mat", "en"), (102, "XQZ!! " * 20000, "en"), (103, "the cat", "xx"), (103, "the cat", "xx")]
    labels = [(i, 1, 0) for i in range(60)] + [(0, None, None), (102, 0, 0), (999, 1, 0)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, lang string, kn_keep string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = keep_good(d, lab)
    assert kept.columns == d.columns
    assert {102} == {r[0] for r in docs} - {r.doc_id for r in kept.collect()} and kept.count() == len(docs) - 1
    assert keep_good(d.limit(0), lab).count() == 0
    assert keep_good(d, lab.limit(0)).count() == len(docs)
    assert judge(d, lab).where("doc_id = 100").first().kn_perplexity == pytest.approx(judge(d, lab).where("doc_id = 101").first().kn_perplexity, rel=0.2)
