"""Streams equal the batch results, across micro-batches, out of order and
after a restart."""

import datetime as dt
import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from parley.operators import context as C
from parley.plans import pipeline as P
from parley.plans.catalog import queries
from parley.sources import driver
from parley.streaming import core as S
from tests.conftest import SF001


def feed(spark, src, parts):
    """Each DataFrame of ``parts`` as one more input file (one micro-batch)."""
    os.makedirs(src, exist_ok=True)
    for df in parts:
        out = f"{src}-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(out)
        os.link(glob.glob(f"{out}/*.parquet")[0], f"{src}/{len(os.listdir(src)):03d}-{uuid.uuid4().hex}.parquet")


def stream(spark, src):
    schema = spark.read.parquet(src).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def shuffled_parts(df, n, seed=1):
    """The rows of ``df`` dealt to ``n`` parts at random: turns out of order."""
    return [df.where(F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(n)) == i) for i in range(n)]


def test_frustration_out_of_order_and_restart(spark, scratch):
    c = spark.read.parquet(f"{SF001}/conversations.parquet")
    parts = shuffled_parts(c, 4)
    src, base = f"{scratch}/in", f"{scratch}/sink"
    run = lambda: S.frustration(driver.map_chat(driver.map_messages(stream(spark, src))), base)
    feed(spark, src, parts[:2])
    run()
    feed(spark, src, parts[2:])
    got = run().select("conversation_id", "turn", "n_prior", "n_frustrated")
    want = C.frustration(driver.chat_messages(spark, SF001), strategy="window")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_frustration_late_turns(spark):
    flags = lambda rows: spark.createDataFrame(rows, "conversation_id long, turn long, f int")
    first = flags([(1, 0, 1), (1, 1, 0), (1, 4, 0), (1, 5, 0)])
    late = flags([(1, 2, 0), (1, 3, 1)])
    got = {tuple(r) for r in S.frustration_updates(late, first, 4).collect()}
    assert got == {(1, 2, 2, 1), (1, 3, 3, 1), (1, 4, 4, 2), (1, 5, 4, 1)}


def test_decisions_out_of_order(spark, scratch):
    """ST5 over shuffled micro-batches: all four tables equal the batch."""
    c = spark.read.parquet(f"{SF001}/conversations.parquet")
    src = f"{scratch}/in"
    feed(spark, src, shuffled_parts(c, 3, seed=5))
    got = S.tables(driver.map_chat(driver.map_messages(stream(spark, src))), f"{scratch}/t")
    d = spark.createDataFrame(P.classify_messages(driver.chat_messages(spark, SF001)).collect(), got["decisions"].schema)
    d = d.withColumn("response_time_ms", F.lit(None).cast("long"))
    want = {"decisions": d, "events": P.events_from(d), "violations": P.violations_from(d), "escalations": P.escalations_from(d)}
    for name, df in want.items():
        rows = lambda x: sorted(map(str, x.select(*df.columns).collect()))
        assert rows(got[name]) == rows(df), name


def test_tables_retry_is_idempotent(spark, scratch):
    m = driver.chat_messages(spark, SF001)
    w = S.write_tables(f"{scratch}/t")
    w(m, 0)
    w(m, 0)
    n = P.classify_messages(m).count()
    assert spark.read.parquet(f"{scratch}/t/decisions").count() == n
    assert spark.read.parquet(f"{scratch}/t/events").count() == 2 * n


def test_dedup_keeps_late_messages(spark, scratch):
    """Distinct messages far behind the newest are kept, copies are dropped."""
    row = lambda conv, turn: (conv, turn, "user", f"text {conv} {turn}")
    schema = "conv_id long, turn long, role string, text string"
    src = f"{scratch}/in"
    feed(spark, src, [spark.createDataFrame(x, schema) for x in (
        [row(900, 0), row(900, 0)], [row(1, 0), row(900, 0)], [row(1, 1), row(1, 0), row(1, 100000), row(2, 0)])])
    out = S.dedup(driver.map_messages(stream(spark, src)), f"{scratch}/t")
    got = sorted((r.conversation_id, r.turn) for r in out.collect())
    assert got == [(1, 0), (1, 1), (1, 100000), (2, 0), (900, 0)]
    assert out.select("id").distinct().count() == 5


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_daily_updates_the_open_day_and_drops_late_rows(spark, scratch):
    d = dt.datetime
    batches = [
        [(1, d(2024, 1, 1, 10), 1, "click", 10.0, "{}"), (2, d(2024, 1, 1, 11), 1, "click", 30.0, "{}"),
         (3, d(2024, 1, 3, 12), 1, "click", 50.0, "{}")],
        [(4, d(2024, 1, 3, 13), 1, "click", 70.0, "{}")],
        [(5, d(2024, 1, 1, 12), 1, "click", 99.0, "{}"),            # behind the watermark: dropped
         (6, d(2024, 1, 3, 14), 1, "click", 90.0, "{}")],
    ]
    src = f"{scratch}/in"
    feed(spark, src, [spark.createDataFrame(rows, EVENTS) for rows in batches])
    out = S.daily(driver.map_events(stream(spark, src)), f"{scratch}/t", "1 hour").collect()
    rows = {(r["date"].isoformat(), r["agent_type"]): (r["count"], r["avg_time"]) for r in out}
    assert rows == {("2024-01-01", "course"): (2, 200.0), ("2024-01-03", "course"): (3, 700.0)}


def test_latency_pairs_in_any_order(spark, scratch):
    d = dt.datetime
    batches = [[(1, "stop", d(2024, 1, 1, 10, 0, 1)), (2, "start", d(2024, 1, 1, 9))],
               [(1, "start", d(2024, 1, 1, 10)), (3, "stop", d(2024, 1, 1, 11))],
               [(2, "stop", d(2024, 1, 2, 9)), (4, "start", d(2024, 1, 1))]]
    src = f"{scratch}/in"
    feed(spark, src, [spark.createDataFrame(b, "request_id long, mark string, at timestamp_ntz") for b in batches])
    got = {r.request_id: r.elapsed_ms for r in S.latency(stream(spark, src), f"{scratch}/t").collect()}
    assert got == {1: 1000, 2: 86_400_000, 3: None}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables, each as a folder of part files."""
    out = str(tmp_path_factory.mktemp("folders"))
    for t in ("conversations", "events"):
        spark.read.parquet(f"{SF001}/{t}.parquet").repartition(3).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", ["stream_classify", "stream_frustration", "stream_daily", "stream_latency", "stream_tables", "stream_dedup"])
def test_streams_read_folder_tables(spark, folders, name):
    whole, parts = (sorted(map(str, queries()[name](spark, d).collect())) for d in (SF001, folders))
    assert whole == parts and whole


def test_appends_are_seen(spark, scratch):
    """A table read twice shows what was appended in between."""
    rows = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"), (F.col("id") % 2).alias("p"))
    rows(0, 4).write.partitionBy("p").parquet(f"{scratch}/conversations.parquet")
    assert driver.messages(spark, scratch).count() == 4
    rows(4, 6).write.mode("append").partitionBy("p").parquet(f"{scratch}/conversations.parquet")
    assert driver.messages(spark, scratch).count() == 6


def test_message_ids_of_long_conversations(spark):
    ids = spark.createDataFrame([(1, 100000), (2, 0), (1, 0), (0, 100000)], "c long, t long").select(driver.message_id(F.col("c"), F.col("t")).alias("id"))
    assert ids.distinct().count() == 4 and ids.where("id < 0 OR id >= 1152921504606846976").count() == 0

