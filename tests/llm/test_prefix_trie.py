import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from parley.llm.prefix_trie import SearchTree, encode, member_hashes, prefix_trie, regraft

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, every=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        root = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = own.get(root, [])[:h] + v[h:]
    return out


def brute(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in conversations.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[:len(k)] == k]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[:-1] == x for y in members)
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        listed = ",".join(map(str, sorted(ends.get(k, []))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below),
                    sum(map(leaf, below)), saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, most=6, **k):
    own, n = encode(df)
    return sorted(map(tuple, prefix_trie(regraft(own, 100, most), n, **k).collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(9)
    texts = ["", "a", "bé", "a b c", "日本", "long " * 9]
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(-150, -95), 10**12]:
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(texts[:2 + c % 5])) for t in range(rnd.randrange(1, 9))]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]  # a group of copies
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rebuilt(rows))
    assert len(want) > 150
    assert result(df) == want
    for options in ({"shard_turns": 10, "fan": 2}, {"shard_turns": 3, "fan": 3}):  # many shards, several merge rounds
        assert result(df, **options) == want
    assert result(df, most=1, shard_turns=40, fan=2) == brute(rebuilt(rows, most=1))


def test_prefixes_across_shards(spark):
    # one first turn in nearly all, sequences that are prefixes of others, a deep chain
    rows = [(7, t, "user", f"deep {t}") for t in range(120)]
    rows += [(1000 + c, t, "system" if t == 0 else "user", "hello" if t == 0 else f"{c // 3 ** t}") for c in range(60) for t in range(c % 6 + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, shard_turns=12, fan=2) == brute(rebuilt(rows))


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "user", ""), (2, None, "", None), (None, 1, "user", "lost"),
            (3, 1, "b", "tie"), (3, 1, "a", "tie"), (100, -1, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", ids long, `a.b` string")
    assert result(df) == brute(rebuilt(rows))
    assert result(df.limit(0)) == []


def test_search_tree():
    rnd = random.Random(1)
    seqs = sorted({tuple(rnd.randrange(6) for _ in range(rnd.randrange(6))) for _ in range(300)})
    tree = SearchTree([list(s) for s in seqs])
    path = {0: ()}
    for x in tree.in_order()[1:]:
        path[x] = (*path[tree.up[x]], tree.split[x])
    assert list(path.values()) == sorted({s[:d] for s in seqs for d in range(len(s) + 1)})
    assert {path[x]: i for x, i in tree.end.items()} == {s: i for i, s in enumerate(seqs)}
    # the medians keep the tree of one level balanced
    wide = SearchTree([[i] for i in range(1023)])
    steps, todo = 0, [wide.eq[0]]
    while todo:
        steps, todo = steps + 1, [y for x in todo for y in (wide.lo[x], wide.hi[x]) if y >= 0]
    assert steps == 10


def test_hash_of_a_group_over_many_tasks(spark):
    df = spark.range(0, 300_000, 1, 7).select(F.lit(1).cast("long").alias("s1"), F.lit(2).cast("long").alias("s2"), F.col("id").alias("conv_id"))
    got = member_hashes(df).collect()
    assert [tuple(r) for r in got] == [(1, 2, hashlib.sha256(",".join(map(str, range(300_000))).encode()).hexdigest())]
