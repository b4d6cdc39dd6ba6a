"""Streams whose state is bounded by Spark's own state store (ST2, ST4, ST6) or
by what a dashboard shows (ST3 / A13), the day-partitioned file sink (S3), and
updates of stored rows (S11).

:mod:`parley.streaming.core` answers rows that come in any order and however
late, and reads its own past for that.  The operators here take event time at
its word: a watermark says how late a row may be, state older than that is
dropped, and a batch costs the same however long the stream has run.

``latency_join``     ST4: stop marks joined with start marks, outer, by event time
``dedup_within``     ST6: copies within the watermark dropped
``keyed_frustration`` ST2: the last flags of every conversation, with a timer
``live_dashboard``   ST3 / A13: the 13-key record folded from batch partials
``events_by_day``    S3: Spark's exactly-once file sink, partitioned by day
``last_logins``      S11: the newest event time of stored users
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.functions.rules import DEFAULT_RULES, RuleSet
from parley.operators import context as C
from parley.operators.latency import elapsed_ms
from parley.plans import dashboard as D
from parley.sources.sinks import write_batch
from parley.sources.stored import KeyedTable
from parley.streaming.core import event_time, run_batches, run_to_table

# -- feeding a folder in time order -------------------------------------------------


def feed(rows: DataFrame, folder: str, at: str, slices: int = 3, tail: Iterable[DataFrame] = ()) -> list:
    """Steps that add ``rows`` to ``folder`` in ``slices`` of rising time, and
    then each of ``tail``; a step is one delivery of a stream that reads the folder.

    The cuts are approximate quantiles; every row is in exactly one slice.
    """
    cuts = rows.agg(F.percentile_approx(F.col(at).cast("timestamp").cast("double"), [i / slices for i in range(1, slices)])).first()[0] or []
    time = F.col(at).cast("timestamp").cast("double")
    part = F.lit(0)
    for c in cuts:
        part = part + F.when(time > c, 1).otherwise(0)
    steps = [lambda i=i: rows.where(part == i).write.mode("append").parquet(folder) for i in range(len(cuts) + 1)]
    return steps + [lambda t=t: t.select(*rows.columns).write.mode("append").parquet(folder) for t in tail]


def read_folder(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(folder)


# -- ST4 ----------------------------------------------------------------------------

def latency_join(starts: DataFrame, stops: DataFrame, delay: str = "1 hour", longest: str = "1 hour") -> DataFrame:
    """ST4 as a stream-stream join: each stop mark (request_id, at) with its
    start, at most ``longest`` before it; a stop without one comes out with NULL
    once the watermark says that none can come.

    Both sides have a watermark, and the time range bounds how long a mark is
    kept: a start for ``longest`` + ``delay``, a stop for ``delay``.
    """
    a = starts.select(F.col("request_id").alias("start_id"), event_time("at").alias("start_time"), F.col("at").alias("started_at")).withWatermark("start_time", delay)
    b = stops.select("request_id", event_time("at").alias("stop_time"), F.col("at").alias("stopped_at")).withWatermark("stop_time", delay)
    near = (F.col("start_id") == F.col("request_id")) & (F.col("start_time") <= F.col("stop_time")) \
        & (F.col("start_time") >= F.col("stop_time") - F.expr(f"INTERVAL {longest}"))
    j = b.join(a, near, "left_outer")
    return j.select("request_id", "started_at", "stopped_at", elapsed_ms(F.col("started_at"), F.col("stopped_at")).alias("elapsed_ms"))


# -- ST6 ----------------------------------------------------------------------------

def dedup_within(messages: DataFrame, delay: str = "1 hour", at: str = "created_at") -> DataFrame:
    """ST6 with bounded state: the first copy of every (conversation, turn); the
    key is forgotten ``delay`` after its first copy's event time."""
    m = messages.withColumn("_time", event_time(at)).withWatermark("_time", delay)
    return m.dropDuplicatesWithinWatermark(C.KEY).drop("_time")


# -- ST2 ----------------------------------------------------------------------------

def _last_flags(frame: int, idle_ms: int):
    """The state function: (turns seen up to ``frame``, their flags as bits, newest time)."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ms", "id"], kind="stable")  # narrow rows of one batch
        seen, bits, newest = state.get if state.exists else (0, 0, int(rows["ms"].iloc[0]))
        n_prior, n_frustrated = [], []
        for f, ms in zip(rows["f"].tolist(), rows["ms"].tolist()):
            if idle_ms and ms - newest > idle_ms:  # also where the timer has not fired yet
                seen, bits = 0, 0
            n_prior.append(seen)
            n_frustrated.append(int(bits).bit_count())
            seen, bits, newest = min(seen + 1, frame), (bits << 1 | int(f)) & ((1 << frame) - 1), max(newest, ms)
        state.update((seen, bits, newest))
        yield pd.DataFrame({"conversation_id": key[0], "turn": rows["turn"].to_numpy(), "n_prior": n_prior, "n_frustrated": n_frustrated})
        if idle_ms:
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))

    return run


def keyed_frustration(messages: DataFrame, rules: RuleSet = DEFAULT_RULES, delay: str = "1 hour", idle_ms: int = 0) -> DataFrame:
    """ST2 as keyed state: W1 inputs of every message of a stream whose
    conversations come in time order from batch to batch.

    A conversation's state is three numbers: how many messages came before (up
    to the frame), their frustration flags as bits, and the newest time.  A
    batch's rows are taken in (time, id) order.  With ``idle_ms`` a message that
    long after the newest starts the conversation anew, and a timer drops its
    state once the watermark is past that.  State rows are bounded by the
    conversations (in use).
    """
    flags = messages.select(*C.KEY, "id", event_time().alias("at"), C.frustrated_flag(rules).alias("f")).withWatermark("at", delay)
    flags = flags.withColumn("ms", F.unix_millis("at"))
    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return flags.groupBy("conversation_id").applyInPandasWithState(
        _last_flags(rules.frustration_frame, idle_ms), "conversation_id long, turn long, n_prior long, n_frustrated long",
        "seen int, bits long, newest long", "append", timeout)


# -- ST3 / A13 ----------------------------------------------------------------------

_EVENT = ["created_at", "id", "event_type", "user_id", "agent_type", "response_time_ms"]
_VIOLATION = ["created_at", "id", "user_id", "violation_type", "original_query", "action_taken", "severity"]
#: a partial: kind of metric, its key (agent, day), count and sum, newest rows
_PARTIAL = ["kind", "name", "n", "total", "event", "violation"]


def _partial(rows: DataFrame, kind: str, name, n, total=None, group: bool = True) -> DataFrame:
    keys = [name.alias("name")] if group else []
    g = rows.groupBy(*keys).agg(n.cast("long").alias("n"), (total if total is not None else F.lit(None)).cast("double").alias("total"))
    return g.select(F.lit(kind).alias("kind"), (F.col("name") if group else F.lit(None)).cast("string").alias("name"), "n", "total")


def _with_feeds(df: DataFrame, events: DataFrame, violations: DataFrame) -> DataFrame:
    kinds = {c: f"struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in d.select(*cols).schema.fields)}>"
             for c, d, cols in (("event", events, _EVENT), ("violation", violations, _VIOLATION))}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _PARTIAL])


def partials(events: DataFrame, escalations: DataFrame, violations: DataFrame, tickets: DataFrame, users: DataFrame) -> DataFrame:
    """What a batch of new rows adds to the dashboard: one row per counter, per
    agent and per day with their counts and sums, and the 20 newest events and
    10 newest violations.  Two of these tables merge by :func:`fold`."""
    one = F.count(F.lit(1))
    rt = F.col("response_time_ms")
    timed = events.where(rt.isNotNull())
    asked = events.where((F.col("event_type") == "query") & F.col("agent_type").isNotNull())
    parts = [
        _partial(events, "event", F.col("event_type"), one),
        _partial(asked, "agent", F.col("agent_type"), one),
        _partial(timed, "day", F.to_date("created_at").cast("string"), one, F.sum(rt)),
        _partial(escalations, "escalations", None, one, group=False),
        _partial(violations, "violations", None, one, group=False),
        _partial(tickets, "ticket", F.col("status"), one),
        _partial(users, "user", F.col("role"), one),
        D.newest(events, 20).select(F.lit("newest_event").alias("kind"), F.struct(*_EVENT).alias("event")),
        D.newest(violations, 10).select(F.lit("newest_violation").alias("kind"), F.struct(*_VIOLATION).alias("violation")),
    ]
    out = None
    for p in parts:
        missing = [c for c in _PARTIAL if c not in p.columns]
        p = p.select("*", *[F.lit(None).cast("string" if c == "name" else "long" if c == "n" else "double").alias(c)
                            for c in missing if c in ("name", "n", "total")])
        p = _with_feeds(p, events, violations)
        out = p if out is None else out.unionByName(p)
    return out


def fold(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two partials as one: counts and sums add up, the newest rows stay.  The
    result has one row per agent, day and status, and 30 feed rows."""
    both = old.unionByName(new)
    sums = both.where(~F.col("kind").startswith("newest_")).groupBy("kind", "name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    empty = both.limit(0)
    feeds = [both.where(F.col("kind") == f"newest_{c}").orderBy(F.col(f"{c}.created_at").desc(), F.col(f"{c}.id").desc()).limit(k)
             for c, k in (("event", 20), ("violation", 10))]
    out = empty.unionByName(sums, allowMissingColumns=True)
    for f in feeds:
        out = out.unionByName(f)
    return out.select(*_PARTIAL)


def record_of(folded: DataFrame) -> DataFrame:
    """The 13-key dashboard record from folded partials (bounded rows)."""
    kind, name = F.col("kind"), F.col("name")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    day = kind == "day"
    agents = F.collect_list(F.when(kind == "agent", F.struct(name, F.col("n"))))
    days = F.collect_list(F.when(day, F.struct(F.to_date(name).alias("date"), (F.col("total") / F.col("n")).alias("avg_time"), F.col("n").alias("count"))))
    t = folded.agg(
        count((kind == "event") & (name == "query")).alias("total_queries"),
        count(kind == "escalations").alias("total_escalations"),
        count((kind == "event") & (name == "escalation")).alias("escalation_events"),
        (F.sum(F.when(day, F.col("total"))) / F.sum(F.when(day, F.col("n")))).alias("avg_rt"),
        count(kind == "violations").alias("total_violations"),
        count((kind == "ticket") & (name != "resolved")).alias("open_tickets"),
        count((kind == "user") & (name == "student")).alias("total_students"),
        count((kind == "ticket") & (name == "resolved")).alias("resolved_tickets"),
        F.map_from_entries(agents).alias("queries_by_agent"),
        F.sort_array(F.collect_list(F.when(kind == "newest_event", F.col("event"))), asc=False).alias("recent_events"),
        F.sort_array(F.collect_list(F.when(kind == "newest_violation", F.col("violation"))), asc=False).alias("recent_violations"),
        F.reverse(F.slice(F.sort_array(days, asc=False), 1, 7)).alias("response_time_trend"),
    )
    rate = D.escalation_rate(F.col("escalation_events"), F.col("total_queries"))
    return t.select(
        "total_queries", "total_escalations", rate.alias("escalation_rate"), D.avg_response(F.col("avg_rt")).alias("avg_response_time_ms"),
        "total_violations", "open_tickets", "total_students", "resolved_tickets",
        D.satisfaction(rate, F.col("total_violations")).alias("satisfaction_score"),
        "queries_by_agent", "recent_events", "recent_violations", "response_time_trend")


def live_dashboard(base: str, split):
    """A ``foreachBatch`` writer: folds each batch into ``<base>/state``.

    ``split(batch)`` gives the batch's new (events, escalations, violations,
    tickets, users).  A batch reads the state of the batch before it (bounded)
    and writes its own, ``<base>/state/batch_id=<n>``: it never reads events
    again, late rows count in their own day, and a replayed batch leaves one copy.
    """

    def fn(batch: DataFrame, batch_id: int) -> None:
        new = partials(*split(batch))
        if batch_id > 0:
            new = fold(batch.sparkSession.read.schema(new.schema).parquet(f"{base}/state/batch_id={batch_id - 1}"), new)
        write_batch(new.coalesce(1), f"{base}/state", batch_id)

    return fn


def live_record(spark: SparkSession, base: str, batch_id: int | None = None) -> DataFrame:
    """The record after a batch (default: the newest)."""
    state = spark.read.parquet(f"{base}/state")
    if batch_id is None:
        batch_id = state.agg(F.max("batch_id")).first()[0]
    return record_of(state.where(F.col("batch_id") == batch_id))


# -- S3 -----------------------------------------------------------------------------

def events_by_day(events: DataFrame, base: str) -> DataFrame:
    """S3 as Spark's exactly-once file sink: events appended to one folder per
    day (``event_date``).  Runs to the end of the input; returns the table."""
    spark = events.sparkSession
    q = (events.withColumn("event_date", F.to_date("created_at")).writeStream.format("parquet").outputMode("append")
         .partitionBy("event_date").option("path", f"{base}/out").option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


# -- S11 ----------------------------------------------------------------------------

def last_logins(events: DataFrame, users: KeyedTable, base: str) -> None:
    """Every micro-batch of events moves ``last_login`` of the stored users
    it names forward, in the buckets it touches.  Rows out of order and replayed
    batches change nothing, because the greatest time stays."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        deltas = batch.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max("created_at").alias("last_login"))
        users.update_greatest(deltas.withColumnRenamed("user_id", "id"), "last_login")

    run_batches(events, fn, f"{base}/login-stream")


__all__ = ["dedup_within", "events_by_day", "feed", "fold", "keyed_frustration", "last_logins", "latency_join",
           "live_dashboard", "live_record", "partials", "read_folder", "record_of", "run_to_table"]
