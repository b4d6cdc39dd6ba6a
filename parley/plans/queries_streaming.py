"""Streaming queries (ST1-ST6): each runs the stream over the whole input
table to completion (``availableNow``) when it is built, and returns the table
it wrote, so it can be compared with the batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import replies
from parley.functions.rules import AGENT_FOR_INTENT, DEFAULT_RULES as R
from parley.plans import dashboard as D
from parley.plans import queries_dashboard as QD
from parley.plans import sql_pipeline as SP
from parley.plans import sql_rules as SR
from parley.plans.catalog import ORACLE, query
from parley.plans.sql import lit, with_views
from parley.sources import driver
from parley.streaming import bounded as B
from parley.streaming import core as S


def _messages(t):
    return driver.map_chat(driver.map_messages(S.table_stream(t.spark, t.sf_dir, "conversations")))


@query("stream_classify", with_views(f"""
    SELECT *, COALESCE(reply = {lit(replies.MODERATED_REPLY)}, FALSE) AS output_filtered FROM (
    SELECT id, conversation_id, turn, violation_type, matched_pattern, intent,
           CASE WHEN {SR.contains_any('t', R.escalation_phrases)} THEN 'student_request'
                WHEN {SR.contains_any('t', R.grading_phrases)} THEN 'grading_dispute'
                WHEN violation_type IS NOT NULL THEN 'policy_violation' END AS stateless_reason,
           {SP.course_topic('t')} AS course_topic, {SP.hint_topic('t')} AS hint_topic,
           {SR.quick_key('t')} AS quick_key,
           CASE WHEN violation_type IS NULL THEN {SP.moderated(SP.agent_reply('agent', 'query', 't'))} END AS reply
    FROM (SELECT *, COALESCE({SR.map_case('intent', AGENT_FOR_INTENT)}, 'course') AS agent
          FROM (SELECT *, CASE WHEN violation_type IS NULL THEN {SR.intent_pick()} END AS intent
                FROM (SELECT *, {SR.intent_scores('t')} FROM gv))))""", "gv"))
def stream_classify(t):
    """ST1: stateless rules and the moderated reply on the message stream."""
    return S.run_to_table(S.classify_stream(_messages(t)), "classify")


@query("stream_frustration", with_views(f"""
    SELECT conversation_id, turn, n_prior, n_frustrated,
           n_prior >= {R.frustration_frame} AND n_frustrated >= {R.frustration_min} AS repeated_frustration
    FROM ctx""", "ctx"))
def stream_frustration(t):
    """ST2: W1 of a message stream; equals the batch window."""
    f = S.frustration(_messages(t), S.new_base(t.spark, "frustration"))
    return f.select("conversation_id", "turn", "n_prior", "n_frustrated",
                    ((F.col("n_prior") >= R.frustration_frame) & (F.col("n_frustrated") >= R.frustration_min))
                    .alias("repeated_frustration"))


@query("stream_daily", with_views("""
    SELECT CAST(created_at AS DATE) AS date, agent_type, avg(response_time_ms) AS avg_time, count(*) AS count
    FROM ev WHERE response_time_ms IS NOT NULL
    GROUP BY CAST(created_at AS DATE), agent_type""", "ev"))
def stream_daily(t):
    """ST3: daily windows, the open last day included."""
    ev = driver.map_events(S.table_stream(t.spark, t.sf_dir, "events"))
    return S.daily(ev, S.new_base(t.spark, "daily"), "1 hour")


@query("stream_latency", with_views("""
    SELECT s.request_id, b.at AS started_at, s.at AS stopped_at, epoch_ms(s.at) - epoch_ms(b.at) AS elapsed_ms
    FROM (SELECT * FROM marks WHERE mark = 'stop') s
    LEFT JOIN (SELECT * FROM marks WHERE mark = 'start') b ON b.request_id = s.request_id""", "marks"))
def stream_latency(t):
    """ST4: every stop of the mark stream with its start (NULL without one)."""
    start, stop = driver.map_marks(S.table_stream(t.spark, t.sf_dir, "events"))
    return S.latency(start.unionByName(stop), S.new_base(t.spark, "latency"))


def _stream_table(name: str, columns: str):
    def build(t):
        return S.tables(_messages(t), S.new_base(t.spark, f"tables-{name}"))[name].drop("response_time_ms")

    build.__doc__ = f"ST5: the {name} written by the foreachBatch sink."
    view = {"decisions": "dec", "events": "pev", "violations": "pviol", "escalations": "pesc"}[name]
    return build, with_views(f"SELECT {columns} FROM {view}", view)


# a reply has not arrived when its message is decided: no response time
for _name, _columns in [("decisions", "* EXCLUDE (response_time_ms)"), ("events", "* EXCLUDE (response_time_ms)"),
                        ("violations", "*"), ("escalations", "*")]:
    _b, _s = _stream_table(_name, _columns)
    query("stream_tables" if _name == "escalations" else f"stream_{_name}", _s)(_b)


@query("stream_dedup", with_views("SELECT * FROM chat_msg", "chat_msg"))
def stream_dedup(t):
    """ST6: redelivered messages dropped, no message lost."""
    return S.dedup(driver.with_redelivery(_messages(t)), S.new_base(t.spark, "dedup"))


# -- bounded state: the same tables delivered in time order, run by run --------------------------

@query("stream_latency_join", ORACLE["stream_latency"])
def stream_latency_join(t):
    """ST4 as a stream-stream outer join with watermarks.  The marks come in
    three runs; then a later mark of each kind comes twice, which moves the
    watermark past the stops that have no start (it holds for the next batch)."""
    marks = driver.request_marks(t.spark, t.sf_dir)
    base = S.new_base(t.spark, "latency-join")
    later = lambda days: marks.agg((F.max("at") + F.expr(f"INTERVAL {days} DAY")).alias("at")).select(
        F.inline(F.array(F.struct(F.lit(-1).cast("long").alias("request_id"), F.lit("start").alias("mark")), F.struct(F.lit(-2).cast("long").alias("request_id"), F.lit("stop").alias("mark")))), "at")
    for deliver in B.feed(marks, f"{base}/marks", "at", 3, [later(1), later(2)]):
        deliver()
        start, stop = (B.read_folder(t.spark, f"{base}/marks", marks).where(F.col("mark") == m) for m in ("start", "stop"))
        out = S.run_to_table(B.latency_join(start, stop), "latency", base)
    return out.where("request_id >= 0")


@query("stream_dedup_bounded", with_views("SELECT * FROM chat_msg", "chat_msg"))
def stream_dedup_bounded(t):
    """ST6 within the watermark: every third message comes again half an hour
    later, in the same run or the next."""
    m = t.chat_messages
    copies = F.when(F.pmod("id", F.lit(3)) == 0, F.array(F.lit(0), F.lit(30))).otherwise(F.array(F.lit(0)))
    sent = m.select("*", F.explode(copies).alias("late")).withColumn("sent_at", F.col("created_at") + F.make_dt_interval(mins=F.col("late"))).drop("late")
    base = S.new_base(t.spark, "dedup-bounded")
    for deliver in B.feed(sent, f"{base}/messages", "sent_at", 3):
        deliver()
        out = S.run_to_table(B.dedup_within(B.read_folder(t.spark, f"{base}/messages", sent)), "dedup", base)
    return out.drop("sent_at")


@query("stream_frustration_state", ORACLE["stream_frustration"])
def stream_frustration_state(t):
    """ST2 as keyed state: W1 of messages that come in time order in three runs."""
    m = t.chat_messages
    base = S.new_base(t.spark, "frustration-state")
    for deliver in B.feed(m, f"{base}/messages", "created_at", 3):
        deliver()
        out = S.run_to_table(B.keyed_frustration(B.read_folder(t.spark, f"{base}/messages", m)), "frustration", base)
    return out.select("conversation_id", "turn", "n_prior", "n_frustrated",
                      ((F.col("n_prior") >= R.frustration_frame) & (F.col("n_frustrated") >= R.frustration_min))
                      .alias("repeated_frustration"))


@query("stream_dashboard", ORACLE["dashboard_record"])
def stream_dashboard(t):
    """ST3 / A13: the 13-key record, folded from the partial aggregates of the
    micro-batches of five tables' new rows."""
    inputs = dict(zip(("event", "escalation", "violation", "ticket", "user"), QD.dashboard_inputs(t)))
    rows = None
    for name, df in inputs.items():
        part = df.select(F.lit(name).alias("source"), F.col("created_at").alias("at"), F.struct("*").alias(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    base = S.new_base(t.spark, "dashboard")
    split = lambda batch: [batch.where(F.col("source") == n).select(f"{n}.*") for n in inputs]
    for deliver in B.feed(rows, f"{base}/changes", "at", 3):
        deliver()
        S.run_batches(B.read_folder(t.spark, f"{base}/changes", rows), B.live_dashboard(base, split), base)
    return D.record_rows(B.live_record(t.spark, base))


@query("stream_events_by_day", with_views("SELECT *, CAST(created_at AS DATE) AS event_date FROM ev", "ev"))
def stream_events_by_day(t):
    """S3: the exactly-once file sink by day, restarted for every delivery."""
    ev = t.events
    base = S.new_base(t.spark, "events-by-day")
    for deliver in B.feed(ev, f"{base}/events", "created_at", 2):
        deliver()
        out = B.events_by_day(B.read_folder(t.spark, f"{base}/events", ev), base)
    return out
