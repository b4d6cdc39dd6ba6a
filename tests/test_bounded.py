"""Streams with bounded state: equal to the batch on input in time order,
restarted between deliveries, with state that does not grow."""

import datetime as dt

from pyspark.sql import functions as F

from parley.operators import context as C
from parley.plans import dashboard as D
from parley.sources import driver
from parley.streaming import bounded as B
from tests.conftest import SF001
from tests.test_streaming import feed, stream

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def progress(df, base, sink="out"):
    """Run to the end of the input; return the table and the state rows of each batch."""
    q = (df.writeStream.format("parquet").option("path", f"{base}/{sink}").option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    return df.sparkSession.read.parquet(f"{base}/{sink}"), rows


MARKS = "request_id long, mark string, at timestamp_ntz"


def test_unmatched_stops_come_after_the_watermark(spark, scratch):
    src, base = f"{scratch}/in", f"{scratch}/s"
    mark = lambda i, kind, m: (i, kind, at(m))
    batches = [
        [mark(1, "start", 0), mark(2, "stop", 1)],      # 2 has no start
        [mark(1, "stop", 5), mark(3, "start", 6)],      # 1 is matched across batches
        [mark(4, "start", 300), mark(4, "stop", 301)],  # the watermark passes 2
        [mark(3, "stop", 310)],                         # longer than an hour: its start is gone
        [mark(9, "start", 900), mark(9, "stop", 901)],
    ]
    seen = []
    for b in batches:
        feed(spark, src, [spark.createDataFrame(b, MARKS)])
        marks = stream(spark, src)
        out, _ = progress(B.latency_join(marks.where("mark = 'start'"), marks.where("mark = 'stop'")), base)
        seen.append(sorted((r.request_id, r.elapsed_ms) for r in out.collect()))
    assert seen[0] == [] and seen[1] == [(1, 300_000)]
    assert (2, None) in seen[2] and (2, None) not in seen[1]
    assert seen[-1] == [(1, 300_000), (2, None), (3, None), (4, 60_000), (9, 60_000)]


def test_state_of_join_and_dedup_stays_flat(spark, scratch):
    """50 batches of ten minutes each: the state holds the last hours only."""
    src = f"{scratch}/in"
    feed(spark, src, [spark.createDataFrame([x for i in range(8) for x in ((100 * b + i, "start", at(10 * b + i)), (100 * b + i, "stop", at(10 * b + i + 1)))], MARKS)
                      for b in range(50)])
    marks = stream(spark, src)
    out, state = progress(B.latency_join(marks.where("mark = 'start'"), marks.where("mark = 'stop'"), "10 minutes", "10 minutes"), f"{scratch}/j")
    assert out.count() == 400 and max(state[40:]) <= max(state[5:15]) and max(state) < 200
    copies = stream(spark, src).select(F.col("request_id").alias("conversation_id"), F.lit(0).cast("long").alias("turn"), F.col("at").alias("created_at"))
    out, state = progress(B.dedup_within(copies, "10 minutes"), f"{scratch}/d")
    assert out.count() == 400  # a start and its stop are two copies of one key
    assert max(state[40:]) <= max(state[5:15]) and max(state) < 100


def test_dedup_forgets_after_the_watermark(spark, scratch):
    src, base = f"{scratch}/in", f"{scratch}/s"
    schema = "conversation_id long, turn long, created_at timestamp_ntz"
    for b in ([(1, 0, at(0)), (1, 0, at(0)), (1, 1, at(1))], [(1, 0, at(30)), (2, 0, at(31))], [(3, 0, at(600))], [(5, 0, at(601))], [(1, 0, at(602)), (4, 0, at(10))]):
        feed(spark, src, [spark.createDataFrame(b, schema)])
    out, _ = progress(B.dedup_within(stream(spark, src)), base)
    got = sorted((r.conversation_id, r.turn) for r in out.collect())
    # the copy within the hour is dropped; ten hours later the key is new; a row behind the watermark is late
    assert got == [(1, 0), (1, 0), (1, 1), (2, 0), (3, 0), (5, 0)]


def test_keyed_state_equals_the_window(spark, scratch):
    m = driver.chat_messages(spark, SF001)
    src, base = f"{scratch}/in", f"{scratch}/s"
    for k, deliver in enumerate(B.feed(m, src, "created_at", 4)):
        deliver()
        df = B.keyed_frustration(B.read_folder(spark, src, m))
        out, state = progress(df, base)  # a new query every time: restarted from its checkpoint
    want = C.frustration(m, strategy="window")
    got = out.select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert max(state) <= m.select("conversation_id").distinct().count()


def test_keyed_state_order_and_timer(spark, scratch):
    schema = "id long, conversation_id long, turn long, role string, content string, created_at timestamp_ntz"
    row = lambda i, conv, turn, m, text="I am so frustrated": (i, conv, turn, "user", text, at(m))
    src, base = f"{scratch}/in", f"{scratch}/s"
    batches = [[row(3, 1, 2, 2), row(1, 1, 0, 0), row(2, 1, 1, 0, "fine")],  # one batch, any order: by time, then id
               [row(4, 1, 3, 3)], [row(5, 2, 0, 500)], [row(6, 2, 1, 501), row(7, 1, 4, 502)]]
    for b in batches:
        feed(spark, src, [spark.createDataFrame(b, schema)])
    out, state = progress(B.keyed_frustration(stream(spark, src), delay="1 minute", idle_ms=3_600_000), base)
    got = {(r.conversation_id, r.turn): (r.n_prior, r.n_frustrated) for r in out.collect()}
    assert [got[1, t] for t in range(4)] == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert got[1, 4] == (0, 0) and got[2, 1] == (1, 1)  # idle for an hour: begun anew


def test_live_dashboard_after_every_batch(spark, scratch):
    e = driver.analytics_events(spark, SF001)
    v = spark.createDataFrame([(i, i % 7, "toxicity", f"q{i}", "blocked", "medium", at(i % 13)) for i in range(60)],
                              "id long, user_id long, violation_type string, original_query string, action_taken string, severity string, created_at timestamp_ntz")
    inputs = [e, driver.escalations(spark, SF001), v, driver.support_tickets(spark, SF001), driver.users(spark, SF001)]
    # batches dealt by hash: most rows of the later ones are late
    part = lambda df, i: df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i)
    upto = lambda df, i: df.where(F.pmod(F.xxhash64("id"), F.lit(3)) <= i)
    base = f"{scratch}/live"
    text = lambda r: sorted(map(tuple, D.record_rows(r).collect()))
    for i in (0, 1, 1, 2, 2):  # replays
        B.live_dashboard(base, lambda b, i=i: [part(df, i) for df in inputs])(e, i)
        assert text(B.live_record(spark, base, i)) == text(D.dashboard_record(*[upto(df, i) for df in inputs]))
    sizes = [spark.read.parquet(f"{base}/state/batch_id={i}").count() for i in range(3)]
    assert sizes[2] < 2 * sizes[0]
    # no rows at all
    none = [df.limit(0) for df in inputs]
    B.live_dashboard(f"{scratch}/none", lambda b: none)(e, 0)
    assert text(B.live_record(spark, f"{scratch}/none")) == text(D.dashboard_record(*none))


def test_day_sink_restarts_and_is_pruned(spark, scratch):
    e = driver.analytics_events(spark, SF001)
    src, base = f"{scratch}/in", f"{scratch}/s"
    for deliver in B.feed(e, src, "created_at", 3):
        deliver()
        out = B.events_by_day(B.read_folder(spark, src, e), base)
    assert B.events_by_day(B.read_folder(spark, src, e), base).count() == e.count()  # nothing new
    assert out.drop("event_date").exceptAll(e.select(*out.drop("event_date").columns)).count() == 0
    day = out.where(F.col("event_date") == out.agg(F.min("event_date")).first()[0])
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_last_logins_out_of_order(spark, scratch):
    from parley.sources.stored import KeyedTable
    table = KeyedTable(spark, f"{scratch}/users", "id", buckets=4)
    table.create(driver.users(spark, SF001))
    e = driver.analytics_events(spark, SF001)
    src = f"{scratch}/in"
    feed(spark, src, [e.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i) for i in range(3)])
    for base in (f"{scratch}/a", f"{scratch}/b"):  # the second run delivers everything again
        B.last_logins(stream(spark, src), table, base)
    want = e.where("user_id is not null").groupBy("user_id").agg(F.max("created_at").alias("t"))
    got = table.read().join(want, F.col("id") == F.col("user_id"), "left")
    assert got.where("NOT last_login <=> t").count() == 0 and got.where("last_login IS NOT NULL").count() > 0
