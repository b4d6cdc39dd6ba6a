"""Context windows (W1-W4) and their skew-safe plans (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from parley.operators import context as C

F_TXT, U_TXT, A_TXT = "I am so frustrated", "what is a list", "here is some help"


def _conv(spark, pattern, conv=1):
    """pattern like 'FaFa' + final user message: F frustrated user, u user,
    a assistant, A assistant with frustrated text."""
    rows = []
    for i, ch in enumerate(pattern + "u"):
        role = "user" if ch in "Fu" else "assistant"
        text = {"F": F_TXT, "u": U_TXT, "a": A_TXT, "A": F_TXT}[ch]
        rows.append((conv * 100 + i, conv, i, role, text))
    return rows


CASES = [("FaF", False), ("FaFa", True), ("uaFa", False), ("FFuau", False), ("AFAu", False)]


@pytest.mark.parametrize("strategy", ["block", "window"])
def test_frustration_cases(spark, strategy):
    rows = []
    for k, (pat, _) in enumerate(CASES):
        rows += _conv(spark, pat, k + 1)
    df = spark.createDataFrame(rows, "id long, conversation_id long, turn long, role string, content string")
    f = C.frustration(df, strategy=strategy)
    last = {k + 1: len(pat) for k, (pat, _) in enumerate(CASES)}
    got = {r.conversation_id: r.rep for r in f.select(
        "conversation_id", "turn", C.is_repeated_frustration(F.col("n_prior"), F.col("n_frustrated")).alias("rep"))
        .collect() if last.get(r.conversation_id) == r.turn}
    assert got == {k + 1: exp for k, (_, exp) in enumerate(CASES)}


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_block_equals_window_on_data(spark, monkeypatch):
    from tests.conftest import SF01
    from parley.sources import driver
    m = driver.chat_messages(spark, SF01)
    for size in (7, 256):  # several blocks per conversation, and one
        monkeypatch.setattr(C, "BLOCK", size)
        assert _same(C.frustration(m), C.frustration(m, strategy="window"))
        assert _same(C.model_context(m), C.model_context(m, "window"))
        h = lambda s: C.handoff_summary(m, F.trim("content"), strategy=s).drop("escalation_reason")
        assert _same(h("block"), h("window"))
        ahead = lambda s: C.over_prior(m.select(*C.KEY, "role"), 2, {"n": F.count("role")}, {"next": F.col("role")}, s)
        assert _same(ahead("block"), ahead("window"))


def _hot(spark, n=3000):
    """One conversation with 9 of 10 rows."""
    m = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, 1 + F.floor(F.col("id") / 1000)).otherwise(0).alias("conversation_id"),
        F.when(F.col("id") % 10 == 0, F.floor(F.col("id") / 10) % 100).otherwise(F.col("id") - F.floor(F.col("id") / 10) - 1).alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 5 == 0, "so angry").otherwise("fine").alias("content"))
    return m


def test_hot_conversation_is_spread(spark):
    m = _hot(spark)
    assert _same(C.frustration(m), C.frustration(m, strategy="window"))
    blocks = m.where("conversation_id = 0").select(F.floor(F.col("turn") / C.BLOCK).alias("b")).groupBy("b").count()
    assert blocks.count() > 8 and blocks.agg(F.max("count")).first()[0] <= C.BLOCK


def test_gaps_raise_and_dense_turns_mends_them(spark):
    m = _hot(spark).where("turn % 2 = 0")
    with pytest.raises(Exception, match="not dense"):
        C.frustration(m).collect()
    with pytest.raises(Exception, match="not dense"):
        C.frustration(m.limit(1).unionByName(m.limit(1))).collect()
    dense = C.dense_turns(m, partitions=5)
    w = C.frustration(m, strategy="window").join(m.select(*C.KEY, "id"), C.KEY).drop("turn", "conversation_id")
    got = C.frustration(dense).join(dense.select(*C.KEY, "id"), C.KEY).drop("turn", "conversation_id")
    assert _same(got.select("id", "n_prior", "n_frustrated"), w.select("id", "n_prior", "n_frustrated"))


def test_message_turns(spark):
    rows = [(3, 1, "2024-01-01 00:00:02"), (1, 1, "2024-01-01 00:00:01"), (2, 1, "2024-01-01 00:00:01"),
            (4, 2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id long, conversation_id long, ts string").select(
        "id", "conversation_id", F.col("ts").cast("timestamp_ntz").alias("created_at"))
    got = {r.id: r.turn for r in C.message_turns(df).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0}


def test_message_turns_range_equals_window_on_hot_conversation(spark):
    """One conversation holds half of all rows; the range plan spreads it
    over several tasks and must still number it exactly like the window."""
    from tests.conftest import SF01
    from parley.sources import driver
    m = driver.messages(spark, SF01).drop("turn")
    hot = m.withColumn("conversation_id", F.when(F.col("conversation_id") % 2 == 0, F.lit(0))
                       .otherwise(F.col("conversation_id")))
    a = C.message_turns(hot, "window").select("id", "conversation_id", "turn")
    b = C.message_turns(hot, "range", partitions=8).select("id", "conversation_id", "turn")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert b.where("conversation_id = 0").agg(F.max("turn")).collect()[0][0] == \
        hot.where("conversation_id = 0").count() - 1


def test_any_turns_by_order(spark):
    """W1-W3 with gaps, repeats and a hot conversation equal the plain windows."""
    import random
    rnd = random.Random(8)
    rows = [(i, 1 if i % 3 else rnd.randrange(2, 30), rnd.randrange(0, 900, 3), rnd.choice(["user", "assistant"]),
             rnd.choice(["I am frustrated", "hello", "this is useless"])) for i in range(3000)]
    rnd.shuffle(rows)
    m = spark.createDataFrame(rows, "id long, conversation_id long, turn long, role string, content string").repartition(5)
    key = ["conversation_id", "turn", "id"]
    same = lambda a, b: a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    item = F.col("content")
    for k in (1, 4, 6):
        got = C.recent_context(m, k, item, None, "order")
        want = C.recent_context(m, k, item, None, "window")
        assert same(got.select(*key, "context"), want.select(*key, "context"))
    f = C.frustration(m, strategy="order")
    flags = C.over_prior(m.select(*key, C.frustrated_flag().alias("_f")), 4, C.frustration_features(), strategy="window")
    assert same(f, flags.select(*key, "n_prior", F.coalesce("n_frustrated", F.lit(0)).alias("n_frustrated")))
    h = C.handoff_summary(m, F.col("content"), strategy="order").where("conversation_id = 1")
    assert h.agg(F.max("conversation_length")).first()[0] >= h.count() - 1
