"""Rules as a table: equal to brute force for many and for odd rules."""

import random

from parley.operators.rule_join import match_rules
from tests.conftest import SF001


def brute(texts, rules):
    return sorted((i, r) for i, t in texts for r, k in rules if t and k and k in t)


def matched(spark, texts, rules, **k):
    df = match_rules(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rules, "rule_id long, keyword string"), **k)
    return sorted(map(tuple, df.collect()))


def test_many_random_rules(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 8)))
    rules = [(i, " ".join(word() for _ in range(rnd.randrange(1, 3)))) for i in range(100_000)]
    texts = [(i, " ".join(word() for _ in range(rnd.randrange(20)))) for i in range(120)]
    df = match_rules(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rules, "rule_id long, keyword string").repartition(8))
    assert sorted(map(tuple, df.collect())) == brute(texts, rules)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_rules_and_texts(spark):
    texts = [(1, None), (2, ""), (3, "ab"), (4, "aaaa\naaaa"), (5, "日本語テキスト"), (6, "smile 😀😀 ok"), (7, "x" * 20000 + "needle")]
    rules = [(1, None), (2, ""), (3, "a"), (4, "ab"), (5, "aaa\naa"), (6, "本語"), (7, "語テキ"), (8, "😀"), (9, "e 😀😀"), (10, "xneedle"), (11, "absent"), (12, "a.b")]
    assert matched(spark, texts, rules) == brute(texts, rules)
    assert matched(spark, texts, [(1, "ab"), (2, "ab")]) == [(3, 1), (3, 2)]
    assert matched(spark, texts, [(1, None)]) == []


def test_a_gram_in_every_text_is_split(spark):
    texts = [(i, f"the common text {i}") for i in range(400)]
    rules = [(i, f"common text {i}") for i in range(40)] + [(100, "the "), (101, "t 39")]
    assert matched(spark, texts, rules, parts_per_task=16) == brute(texts, rules)


def test_catalog_as_a_table(spark):
    from parley.plans.catalog import queries
    q = queries()
    rows = lambda n: sorted(map(tuple, q[n](spark, SF001).select("id", "intent").collect()))
    assert rows("keyword_rule_table") == rows("keyword_rule_join")
