import math

import pytest

from parley.llm.mixing import apply_mix, mix_sources


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Reshare the excess by weight until no target is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(capped.values())
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > 2 * sizes[s]]
        if not over:
            return capped | goal
        capped |= {s: 2.0 * sizes[s] for s in over}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), [None, "b", "a", "é", "zz"][min(i % 9, 4)], "x") for i in range(3000)]
    got = mix_sources(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s]
        assert mine[0].rate == pytest.approx(want[s] / sizes[s], rel=1e-6)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 40
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    again = mix_sources(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_edges(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (None, "one two", None, "x"), (3, "w " * 50000, "hot", "x"), (3, "w " * 50000, "hot", "x"), (4, "   ", "empty", "x")]
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == 6 and all(not math.isnan(r.target) for r in got)
    assert [r.target for r in got if r.source in ("a", "empty")] == [0, 0, 0]
    assert mix_sources(frame(spark, rows).limit(0)).count() == 0
    assert {r.taken for r in mix_sources(frame(spark, [(1, "", "a", "x")])).collect()} == {0}
    out = apply_mix(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "size", "mix_size", "mix_target", "mix_copies"]
    assert all(r.mix_copies > 0 and r.size == "x" for r in out.collect())


def test_dotted_and_clashing_columns(spark):
    from parley.llm.mixing import apply_mix
    df = spark.createDataFrame([(i, "s", "a b c", 9, "k") for i in range(4)], "doc_id long, source string, text string, mix_copies int, `a.b` string")
    out = apply_mix(df)
    assert out.columns == ["doc_id", "source", "text", "a.b", "mix_size", "mix_target", "mix_copies"]
    assert {(r["a.b"], r["mix_size"]) for r in out.collect()} == {("k", 3)}
