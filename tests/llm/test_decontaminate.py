import hashlib
import random

from parley.llm.decontaminate import find_contamination, item_words, remove_contamination


def brute(docs, items, window=10):
    wins = {}
    for ident, text in items:
        w = item_words(text.encode()) if text else []
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(ident)
    out = {}
    for ident, text in docs:
        w = item_words(text.encode()) if text else []
        hit, found = set(), set()
        for k, ids in wins.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i:i + len(k)]) == k:
                    hit |= set(range(i, i + len(k)))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out[ident] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0)
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_random_against_brute_force(spark):
    rnd = random.Random(3)
    for trial in range(4):
        word = lambda: rnd.choice("ab cd ef gh é7 Ij".split())
        items = [(i, " ".join(word() for _ in range(rnd.choice([2, 5, 9, 10, 11, 14])))) for i in range(8)]
        docs = []
        for i in range(40):
            t = [word() for _ in range(rnd.randint(0, 60))]
            if rnd.random() < 0.6:
                t[5:5] = rnd.choice(items)[1].upper().split()
            docs.append((i, rnd.choice([" ", ", ", "\n"]).join(t)))
        for part_words in (5, 1000):
            got = rows(find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part_words=part_words))
            assert got == brute(docs, items)


def test_edges(spark):
    words = [f"w{i}" for i in range(10)]
    docs = [(1, None), (2, ""), (3, "  !! "), (4, " ".join(words)), (4, " ".join(words)), (None, "x " + "-".join(w.upper() for w in words) + " y"), (6, "z " * 50000 + "one"), (7, " ".join(words[:9]))]
    items = [(1, " ".join(words)), (1, " ".join(words)), (None, "one"), (3, None), (4, "")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_hit, r.n_items) for r in find_contamination(d, i).collect())
    assert got == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 10, 10, 1), (4, 10, 10, 1), (0, 12, 10, 1), (6, 50001, 1, 0), (7, 9, 0, 0)])
    assert find_contamination(d.limit(0), i).count() == 0
    assert find_contamination(d, i.limit(0)).where("contaminated").count() == 0


def test_removal_keeps_columns_and_clean_text(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before  this, {words}! After.", 5), (2, words, 6), (3, "clean text", 7)], "doc_id long, text string, n_hit int")
    out = {r.doc_id: (r.text, r.n_hit) for r in remove_contamination(docs, spark.createDataFrame([(1, words)], "item_id long, text string"), max_coverage=0.8).collect()}
    assert out == {1: ("Before  this, ! After.", 5), 3: ("clean text", 7)}
