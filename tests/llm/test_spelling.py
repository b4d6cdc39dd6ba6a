import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parley.llm.spelling import Direction, near_words, spelling_groups, suffix_order

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out.add(word[:i] + word[i + 1:])
            out |= {word[:i] + c + word[i + 1:] for c in letters}
    return out - {word}


def brute(docs, damage=97):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % damage else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = set("".join(n))
    forms, rows = {}, []
    for w, k in n.items():
        near = [x for x in edits(w, letters) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if near and n[best] >= 2 * k else None
        rows.append((w, len(near)))
    out = []
    for w, near in rows:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], near, n[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def result(df, **k):
    return sorted(map(tuple, spelling_groups(df, **k).collect()), key=str)


def corpus(seed, size=400):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcdeéÿ") for _ in range(rnd.randrange(4, 10))) for _ in range(40)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "×÷×÷×", "ABCDE", "straße", "Straße"]
    docs = []
    for i in range(size):
        words = []
        for _ in range(rnd.randrange(30)):
            w = rnd.choice(stems)
            if rnd.random() < 0.5:
                w = rnd.choice(sorted(edits(w, "abé")))
            words.append(w)
        docs.append((rnd.choice([i, 7]), rnd.choice([" ", ", ", "1", "日"]).join(words)))
    return docs


def test_against_brute_force(spark):
    docs = corpus(1) + [(9000 + i, w) for w, n in (("chainaa", 32), ("chainab", 15), ("chaincb", 7), ("xchaincb", 3)) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs)
    assert len(want) > 200 and any(r[2] not in (r[0], r[1]) for r in want)
    assert result(df) == want
    # few words a shard: frequent halves are dealt to parts of their own
    assert result(df, shard_words=5) == want
    assert result(df, damage=3) == brute(docs, 3)


def test_a_third_of_all_words_share_a_half(spark):
    words = [f"prefi{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + [f"{chr(97 + i // 26)}{chr(97 + i % 26)}uffix" for i in range(300)]
    docs = [(i, " ".join(words)) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(df, shard_words=40) == brute(docs)


def test_edges(spark):
    long = "x" * 3000 + "y"
    docs = [(1, None), (2, ""), (None, "hello world"), (None, "hello World HELLO"), (3, f"{long} {long[1:]}"), (4, f"{long} {long[1:]}"),
            (4, f"{long} {long[1:]}"), (5, "hellö hell0 hello hellö hellö"), (6, "word " * 50_000)]
    df = spark.createDataFrame([(*d, 3, "z") for d in docs], "doc_id long, text string, n long, `a.b` string")
    assert result(df) == brute(docs)
    assert result(df.limit(0)) == []


def test_suffix_order_and_search():
    rnd = random.Random(4)
    for letters in ("ab", "abcdé"):
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 9))) for _ in range(150)})
        text = np.array([0, 1, 2, 1, 2, 0, 1, 2, 0])
        assert suffix_order(text).tolist() == sorted(range(9), key=lambda i: text[i:].tolist())
        index = Direction(words)
        assert index.size == sum(map(len, words)) + len(words) + 1
        n = np.arange(len(words)) % 7
        got = {}
        for mirrored in (True, False):
            for w, c, form, k in zip(*near_words(words, words, n, mirrored, block=32)):
                c0, best = got.get(w, (0, (1, "")))
                got[w] = (c0 + c, min(best, (-k, form)))
        for w in words:
            near = [x for x in edits(w, letters) if x in words]
            if near:
                assert got[w] == (len(near), min((-n[words.index(x)], x) for x in near))
            else:
                assert w not in got
