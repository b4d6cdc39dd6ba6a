"""Structured Streaming forms of the pipeline (ST1-ST6).

Sources are file streams over the driver tables, single files or folders of
part files.  Every stream keeps its progress in a checkpoint under the shared
``spark.checkpoint.dir``, so a restarted query resumes where it stopped.

Operators whose answer can change when late rows arrive (ST2-ST5) and the ones
that need their own past (ST6) run in ``foreachBatch`` on ordinary DataFrames:
each micro-batch writes its results to ``<table>/batch_id=<n>``, replaced when
the batch is retried, and a later batch writes a corrected row for the same key
(:func:`latest` reads the newest).  No row is dropped for being late, no
group is gathered in a Python worker, and a conversation that holds most of a
batch is spread over tasks by (conversation, turn).

ST1  classify_stream   stateless rules per message (G, I, T, stateless E1, G6)
ST2  frustration       W1 of every message, corrected when late turns arrive
ST3  daily_stream      event-time day windows with a watermark, updated in place
ST4  latency           every stop mark with its start, corrected likewise
ST5  tables            decisions / events / violations / escalations
ST6  dedup             one copy of every message, whenever a copy arrives
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.rules import DEFAULT_RULES, RuleSet
from parley.functions.text import strip_ws
from parley.operators import context as C
from parley.operators import routing as RT
from parley.operators.escalation import escalation_reason
from parley.operators.guardrails import with_violation
from parley.operators.latency import elapsed_ms
from parley.plans import pipeline as P
from parley.session import scratch_path
from parley.sources.sinks import write_batch

# -- sources, sinks and runners ---------------------------------------------------


def _path_status(spark: SparkSession, path: str):
    """Hadoop's status of a path on any file system, None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """A file stream of one driver table: a folder of part files, or the one
    file ``<folder>/<name>.parquet``."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if _path_status(spark, path).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def new_base(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's tables under the shared folder."""
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def run_to_table(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run a stateless streaming DataFrame to completion (``availableNow``)
    into a Parquet sink under the shared folder; return it as a table."""
    spark = df.sparkSession
    base = base or new_base(spark, name)
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], base: str, output_mode: str = "append") -> None:
    """Run ``fn`` on every micro-batch until the input is exhausted."""
    q = (df.writeStream.foreachBatch(fn).outputMode(output_mode)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


def earlier(like: DataFrame, path: str, batch_id: int) -> DataFrame:
    """What batches before ``batch_id`` wrote to ``path`` (columns of ``like``)."""
    spark = like.sparkSession
    if _path_status(spark, path) is None:
        return like.limit(0)
    return spark.read.parquet(path).where(F.col("batch_id") < batch_id).select(*like.columns)


def latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The newest row of every key of a table written batch by batch."""
    t = spark.read.parquet(path)
    rest = [c for c in t.columns if c not in (*key, "batch_id")]
    newest = t.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return newest.select(*key, "r.*")


def event_time(c: str = "created_at"):
    """Watermarks need ``timestamp`` (not ``timestamp_ntz``): read the wall
    clock as UTC (the session time zone)."""
    return F.col(c).cast("timestamp")


# -- ST1 ----------------------------------------------------------------------------

def classify_stream(messages: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """ST1: the per-message rules that need no context, on a message stream,
    with the routed agent's moderated reply (G6)."""
    q = messages.where(F.col("role") == "user").select(
        "id", "conversation_id", "turn", "user_id", "created_at",
        strip_ws(F.col("content")).alias("query"))
    q = q.where(F.length("query") > 0)
    v = with_violation(q, "query", rules, keep_text=True)
    blocked = F.col("violation_type").isNotNull()
    v = v.withColumn("intent", F.when(~blocked, RT.keyword_intent(F.col("_t"), rules)))
    agent = RT.agent_for_intent(F.col("intent"))
    v = v.withColumn("reply", F.when(~blocked, RT.agent_reply(agent, F.col("query"), F.col("_t"), rules)))
    return v.select(
        "id", "conversation_id", "turn", "violation_type", "matched_pattern", "intent",
        escalation_reason(F.col("_t"), F.lit(0), F.lit(0), blocked, rules).alias("stateless_reason"),
        RT.course_topic(F.col("_t"), rules).alias("course_topic"),
        RT.hint_topic(F.col("_t"), rules).alias("hint_topic"),
        RT.quick_key(F.col("_t"), rules).alias("quick_key"),
        "reply", F.coalesce(F.col("reply") == F.lit(P.replies.MODERATED_REPLY), F.lit(False)).alias("output_filtered"),
    )


# -- ST2 ----------------------------------------------------------------------------

def frustration_updates(flags: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """W1 inputs of the turns whose frame changes with the new ``flags``.

    ``flags`` and ``state`` are (conversation_id, turn, f), new and earlier.
    The turn of a new row and the ``k`` turns after it, where they exist, are
    computed from the turns before them.  Everything is keyed by (conversation,
    turn) or a block of turns and carries no text.
    """
    near = lambda d, block: F.floor((F.col("turn") + d) / block)
    blocks = flags.select("conversation_id", F.explode(F.array(near(-k, C.BLOCK), near(2 * k, C.BLOCK))).alias("b")).distinct()
    state = state.withColumn("b", near(0, C.BLOCK)).join(blocks, ["conversation_id", "b"], "left_semi").drop("b")
    rows = state.join(flags, C.KEY, "left_anti").unionByName(flags).dropDuplicates(C.KEY)
    changed = flags.select("conversation_id", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("d"), "turn")
    changed = changed.select("conversation_id", (F.col("turn") + F.col("d")).alias("turn")).distinct()
    changed = changed.join(rows.select(*C.KEY), C.KEY, "left_semi")
    prior = rows.select("conversation_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("d"), "turn", "f")
    prior = prior.select("conversation_id", (F.col("turn") + F.col("d")).alias("turn"), "f")
    prior = prior.groupBy(*C.KEY).agg(F.count(F.lit(1)).alias("n_prior"), F.sum("f").cast("long").alias("n_frustrated"))
    zero = F.lit(0).cast("long")
    return changed.join(prior, C.KEY, "left").select(
        *C.KEY, F.coalesce("n_prior", zero).alias("n_prior"), F.coalesce("n_frustrated", zero).alias("n_frustrated"))


def _frustration_batch(base: str, rules: RuleSet):
    """Writes the batch's flags (the state) and the updated W1 inputs."""
    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        write_batch(batch.select(*C.KEY, C.frustrated_flag(rules).alias("f")).dropDuplicates(C.KEY), f"{base}/flags", batch_id)
        flags = spark.read.parquet(f"{base}/flags/batch_id={batch_id}")
        updates = frustration_updates(flags, earlier(flags, f"{base}/flags", batch_id), rules.frustration_frame)
        write_batch(updates, f"{base}/frustration", batch_id)
        return spark.read.parquet(f"{base}/frustration/batch_id={batch_id}")
    return fn


def frustration(messages: DataFrame, base: str, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """ST2: W1 inputs of every message of a stream, in any order of arrival.

    The state is one narrow row (conversation, turn, flag) per message; a
    batch reads the blocks of turns around its own rows.  A late turn corrects
    the later turns whose frame it falls in.  Runs the stream to the end of
    its input and returns the current table.
    """
    step = _frustration_batch(base, rules)
    run_batches(messages, lambda b, i: (step(b, i), None)[1], base)
    return latest(messages.sparkSession, f"{base}/frustration", C.KEY)


# -- ST3 ----------------------------------------------------------------------------

def daily_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST3: per day and agent, average and count of timed events.

    Tumbling 1-day windows on event time; a day's state is dropped once the
    watermark passes its end, and rows later than that are dropped.
    """
    e = events.select("agent_type", "response_time_ms", event_time().alias("event_time"))
    e = e.withWatermark("event_time", delay).where(F.col("response_time_ms").isNotNull())
    g = e.groupBy(F.window("event_time", "1 day").alias("w"), "agent_type").agg(
        F.avg("response_time_ms").alias("avg_time"), F.count(F.lit(1)).alias("count"))
    return g.select(F.to_date(F.col("w.start")).alias("date"), "agent_type", "avg_time", "count")


def daily(events: DataFrame, base: str, delay: str = "1 hour") -> DataFrame:
    """ST3 to a table: days are updated as rows arrive, the open one included."""
    run_batches(daily_stream(events, delay), lambda b, i: write_batch(b, f"{base}/daily", i), base, "update")
    return latest(events.sparkSession, f"{base}/daily", ["date", "agent_type"])


# -- ST4 ----------------------------------------------------------------------------

def pair_marks(marks: DataFrame, past: DataFrame) -> DataFrame:
    """The stops to (re)write when ``marks`` arrive after ``past``: new stops,
    and earlier ones whose start comes now; NULL elapsed without a start."""
    starts = past.where("mark = 'start'").unionByName(marks.where("mark = 'start'"))
    late = marks.where("mark = 'start'").select("request_id")
    stops = marks.where("mark = 'stop'").unionByName(past.where("mark = 'stop'").join(late, "request_id", "left_semi"))
    stops = stops.groupBy("request_id").agg(F.min("at").alias("stopped_at"))
    starts = starts.join(stops.select("request_id"), "request_id", "left_semi").groupBy("request_id").agg(F.min("at").alias("started_at"))
    j = stops.join(starts, "request_id", "left")
    return j.select("request_id", "started_at", "stopped_at", elapsed_ms(F.col("started_at"), F.col("stopped_at")).alias("elapsed_ms"))


def latency(marks: DataFrame, base: str) -> DataFrame:
    """ST4: every stop mark of a stream (request_id, mark, at) with its start,
    in any order of arrival; a stop without a start has NULL elapsed."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select("request_id", "mark", "at"), f"{base}/marks", batch_id)
        new = batch.sparkSession.read.parquet(f"{base}/marks/batch_id={batch_id}")
        write_batch(pair_marks(new, earlier(new, f"{base}/marks", batch_id)), f"{base}/latency", batch_id)

    run_batches(marks, fn, base)
    return latest(marks.sparkSession, f"{base}/latency", ["request_id"])


# -- ST5 ----------------------------------------------------------------------------

TABLES = ("decisions", "events", "violations", "escalations")
_ASKED = ["id", "conversation_id", "turn", "user_id", "created_at", "query"]


def write_tables(base: str, rules: RuleSet = DEFAULT_RULES):
    """foreachBatch writer: decides the batch's messages, and anew the earlier
    ones whose context it changes, and writes the four derived tables.

    Each table of a batch is written to ``<base>/<table>/batch_id=<n>`` and the
    derived ones read the written decisions, so a retry of the batch leaves
    exactly one copy and decides nothing twice.
    """
    step = _frustration_batch(base, rules)

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        context = step(batch, batch_id)
        new = batch.where(F.col("role") == "user").withColumn("query", strip_ws(F.col("content"))).where(F.length("query") > 0)
        new = new.select(*_ASKED).dropDuplicates(C.KEY)
        old = earlier(new, f"{base}/decisions", batch_id).join(new, C.KEY, "left_anti").join(context, C.KEY, "left_semi")
        asked = new.unionByName(old.dropDuplicates(C.KEY)).join(context, C.KEY)
        # the reply has not arrived when a message is decided: no response time
        decided = P.decide(asked.withColumn("reply_at", F.lit(None).cast("timestamp_ntz")), rules)
        write_batch(decided, f"{base}/decisions", batch_id)
        decisions = spark.read.schema(decided.schema).parquet(f"{base}/decisions/batch_id={batch_id}")
        write_batch(P.events_from(decisions), f"{base}/events", batch_id)
        write_batch(P.violations_from(decisions), f"{base}/violations", batch_id)
        write_batch(P.escalations_from(decisions), f"{base}/escalations", batch_id)
    return fn


def tables(messages: DataFrame, base: str, rules: RuleSet = DEFAULT_RULES) -> dict[str, DataFrame]:
    """ST5: run the message stream into the four tables; return them as they
    stand (rows of decisions that a later batch replaced are left out)."""
    run_batches(messages, write_tables(base, rules), base)
    spark = messages.sparkSession
    read = {n: spark.read.parquet(f"{base}/{n}") for n in TABLES}
    valid = read["decisions"].groupBy(F.col("id").alias("_id")).agg(F.max("batch_id").alias("_batch"))
    message = {"events": F.shiftright("id", 1)}  # two events per message
    return {n: t.join(valid, (message.get(n, F.col("id")) == F.col("_id")) & (F.col("batch_id") == F.col("_batch")), "left_semi").drop("batch_id")
            for n, t in read.items()}


# -- ST6 ----------------------------------------------------------------------------

def dedup(messages: DataFrame, base: str) -> DataFrame:
    """ST6: one copy of every message (conversation, turn), the first to
    arrive.  A copy is dropped however late it comes, a new message never."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        seen = earlier(batch.select(*C.KEY), f"{base}/messages", batch_id)
        write_batch(batch.dropDuplicates(C.KEY).join(seen, C.KEY, "left_anti"), f"{base}/messages", batch_id)

    run_batches(messages, fn, base)
    return messages.sparkSession.read.parquet(f"{base}/messages").drop("batch_id")
