"""Message pipeline: decisions and the tables derived from them.

``classify_messages(messages)`` turns a table of conversation turns into
one decision per user message, exactly like processing the messages one by
one with their prior context:

1. input guardrails (G5) -> blocked, always escalated;
2. keyword intent (I1);
3. escalation (E1: phrases, grading, repeated frustration, violation);
4. routing to an agent and its fallback reply (J7, R1) with output
   moderation (G6).

Plan: one exchange, keyed by (conversation_id, block of turns), carries every
message once (and a block's last rows twice) to its context; everything else is
narrow column expressions (see :mod:`parley.operators.context`).  Derived
tables never filter on a derived rule column of a lazy plan (the filter would
be pushed below the projection and re-run every rule); they either filter on an
equivalent base-column predicate or read materialised decisions
(:func:`materialize`).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import replies
from parley.functions.rules import DEFAULT_RULES, RuleSet
from parley.functions.text import left, norm, rlike_any, short_id, strip_ws
from parley.operators import context as C
from parley.operators.escalation import escalation_reason, escalation_reply
from parley.operators.guardrails import all_input_rules, context_key, violation_message, with_violation
from parley.operators.routing import agent_for_intent, agent_reply, keyword_intent, model_intent
from parley.session import materialize

KEY = ["conversation_id", "turn"]


ANSWERS = ["answer_a", "answer_b", "search_answer"]
WIKI = ["wiki_title", "wiki_extract"]
OPTIONAL = ANSWERS + WIKI + ["model_label"]


def _queries(messages: DataFrame) -> DataFrame:
    """User turns with the stripped, non-empty ``query``."""
    extra = [c for c in OPTIONAL + ["n_prior", "n_frustrated", "reply_at"] if c in messages.columns]
    q = messages.where(F.col("role") == "user").select(
        "id", *KEY, "user_id", "created_at", strip_ws(F.col("content")).alias("query"), *extra)
    return q.where(F.length("query") > 0)


def prepare(messages: DataFrame, rules: RuleSet = DEFAULT_RULES, strategy: str = "block") -> DataFrame:
    """User turns (stripped, non-empty) with their context features: the W1
    inputs and the time of the reply, from one pass over the messages.

    Candidate answers (``answer_a``, ``answer_b``, ``search_answer``,
    ``wiki_title`` / ``wiki_extract``) and a model's intent label (``model_label``) are carried
    along when the messages have them (see :func:`decide`).
    """
    reply = F.when(F.col("role") == "assistant", F.col("created_at"))
    m = messages.withColumn("_f", C.frustrated_flag(rules)).withColumn("_reply", reply)
    m = C.over_prior(m, rules.frustration_frame, C.frustration_features(rules), {"reply_at": F.col("_reply")}, strategy)
    return _queries(m.withColumn("n_frustrated", F.coalesce("n_frustrated", F.lit(0)).cast("long")))


@functools.lru_cache(maxsize=64)
def _decision_columns(rules: RuleSet, ctx: str, with_answers: bool = False, with_wiki: bool = False,
                      with_label: bool = False):
    """The decision expressions over fixed column names, built once per rule
    set and Spark application (thousands of Column objects otherwise rebuilt
    through the JVM gateway on every plan)."""
    t = F.col("_t")
    blocked = F.col("violation_type").isNotNull()
    stage1 = [escalation_reason(t, F.col("n_prior"), F.col("n_frustrated"), blocked, rules).alias("escalation_reason"),
              F.when(~blocked, model_intent(F.col("model_label"), t, rules) if with_label
                     else keyword_intent(t, rules)).alias("intent")]
    escalated = F.col("escalation_reason").isNotNull()
    stage2 = [F.when(blocked, F.lit("orchestrator")).when(escalated, F.lit("escalation"))
              .otherwise(agent_for_intent(F.col("intent"))).alias("agent_type")]
    if with_answers:
        # Model answers, web search, knowledge base, encyclopedia, generic
        # text; the raw answer gets its own projection and G6 reads that column
        from parley.operators.guardrails import moderate_output
        from parley.operators.routing import answer_failover
        wiki = tuple(F.col(c) for c in WIKI) if with_wiki else None
        raw = answer_failover(F.col("agent_type"), F.col("query"), t, *[F.col(c) for c in ANSWERS], rules, wiki)[0]
        stage2 = stage2 + [F.when(~blocked & ~escalated, raw).alias("_routed")]
        routed = moderate_output(F.col("_routed"), rules)[0]
    else:
        routed = agent_reply(F.col("agent_type"), F.col("query"), t, rules)
    reply = (F.when(blocked, violation_message(F.col("violation_type")))
             .when(escalated, escalation_reply(F.col("escalation_reason")))
             .otherwise(routed))
    stage3 = [
        "id", *KEY, "user_id", "created_at", "query",
        short_id("conversation_id", "turn").alias("request_id"),
        blocked.alias("guardrail_triggered"), "violation_type", "matched_pattern", "severity",
        "intent", escalated.alias("escalated"), "escalation_reason", "agent_type", reply.alias("response"),
        (F.unix_millis(F.col("reply_at").cast("timestamp")) - F.unix_millis(F.col("created_at").cast("timestamp")))
        .alias("response_time_ms"),
    ]
    return stage1, stage2, stage3


def decide(prepared: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """P1 on prepared rows: the decision columns (three projections).

    Without candidate answers the routed agent's reply is its fallback
    chain (knowledge base / hints / quick fixes / generic text); with the
    ``answer_a``, ``answer_b``, ``search_answer`` (and ``wiki_*``) columns
    present it is the I3 failover over them.  With a ``model_label`` column the intent is I2
    (the model's label when it is a known one, else the keyword intent).
    """
    has = lambda *cs: all(c in prepared.columns for c in cs)
    s1, s2, s3 = _decision_columns(rules, context_key(), has(*ANSWERS), has(*WIKI), has("model_label"))
    d = with_violation(prepared, "query", rules, keep_text=True)
    d = d.select("*", *s1).select("*", *s2).select(*s3)
    # the moderation flag reads the response column: one evaluation of the reply
    filtered = (~F.col("guardrail_triggered")) & (~F.col("escalated")) & \
        (F.col("response") == F.lit(replies.MODERATED_REPLY))
    cols = [c for c in d.columns if c != "response_time_ms"]
    return d.select(*cols, filtered.alias("output_filtered"), "response_time_ms")


def classify_messages(messages: DataFrame, rules: RuleSet = DEFAULT_RULES, strategy: str = "block") -> DataFrame:
    """One decision per (non-empty) user message.

    ``messages`` columns: id, conversation_id, turn (dense, 0-based),
    user_id, role, content, created_at.
    """
    return decide(prepare(messages, rules, strategy), rules)


# -- cheap equivalent predicates (evaluated on base columns) --------------------

def blocked_predicate(rules: RuleSet = DEFAULT_RULES) -> Column:
    """``guardrail_triggered`` without building the violation columns."""
    return rlike_any(norm(F.col("query")), all_input_rules(rules))


# -- P2, P3, P4 ------------------------------------------------------------------------

def _meta(key: str, value: Column) -> Column:
    return F.to_json(F.create_map(F.lit(key), value))


def events_from(decisions: DataFrame) -> DataFrame:
    """Two analytics events per decision (outcome table of the pipeline).

    blocked   -> (guardrail_trigger, NULL, {"type"}), (response, guardrails)
    escalated -> (escalation, escalation, {"reason"}), (response, escalation)
    normal    -> (query, agent), (response, agent)
    One ``explode`` of a 2-element array: narrow, no shuffle.
    """
    blocked, escalated = F.col("guardrail_triggered"), F.col("escalated")
    first = F.struct(
        F.when(blocked, "guardrail_trigger").when(escalated, "escalation").otherwise("query").alias("event_type"),
        F.when(blocked, F.lit(None).cast("string")).otherwise(F.col("agent_type")).alias("agent_type"),
        F.when(blocked, _meta("type", F.col("violation_type")))
        .when(escalated, _meta("reason", F.col("escalation_reason"))).otherwise(F.lit("{}")).alias("metadata"),
        F.lit(None).cast("long").alias("response_time_ms"),
        F.lit(0).alias("seq"),
    )
    second = F.struct(
        F.lit("response").alias("event_type"),
        F.when(blocked, F.lit("guardrails")).otherwise(F.col("agent_type")).alias("agent_type"),
        F.lit("{}").alias("metadata"),
        F.col("response_time_ms").alias("response_time_ms"),
        F.lit(1).alias("seq"),
    )
    e = decisions.select("id", "user_id", "created_at", F.explode(F.array(first, second)).alias("e"))
    return e.select(
        (F.col("id") * 2 + F.col("e.seq")).alias("id"),
        F.col("e.event_type").alias("event_type"), "user_id",
        F.col("e.agent_type").alias("agent_type"), F.col("e.metadata").alias("metadata"),
        F.col("e.response_time_ms").alias("response_time_ms"), "created_at",
    )


def request_events(kind: str, requests: DataFrame) -> DataFrame:
    """P2 for requests outside the message flow, one event each:
    ``ticket_created`` (accepted tickets, {"category"}) and manual
    ``escalation`` (agent escalation, {"reason"})."""
    key, agent = {"ticket_created": ("category", F.lit(None).cast("string")), "escalation": ("reason", F.lit("escalation"))}[kind]
    return requests.select(
        F.col("request_id").alias("source_id"), F.lit(kind).alias("event_type"), "user_id", agent.alias("agent_type"),
        _meta(key, F.col(key)).alias("metadata"), F.lit(None).cast("long").alias("response_time_ms"), "created_at")


def all_events(decisions: DataFrame, tickets: DataFrame, escalations: DataFrame) -> DataFrame:
    """The analytics events of decisions, accepted tickets and manual
    escalations.  ``source`` and ``source_id`` name the row they come from."""
    own = events_from(decisions).withColumnRenamed("id", "source_id").withColumn("source", F.lit("message"))
    t = request_events("ticket_created", tickets.where("accepted")).withColumn("source", F.lit("ticket"))
    e = request_events("escalation", escalations).withColumn("source", F.lit("escalation"))
    return own.unionByName(t).unionByName(e)


def violations_from(decisions: DataFrame) -> DataFrame:
    """Violation rows (query cut to 500 characters, action blocked)."""
    return decisions.where(F.col("guardrail_triggered")).select(
        "id", "user_id", "violation_type", left(F.col("query"), 500).alias("original_query"),
        F.lit("blocked").alias("action_taken"), "severity", "created_at")


def escalations_from(decisions: DataFrame) -> DataFrame:
    """Escalation rows (summary = query[:200], high when blocked)."""
    return decisions.where(F.col("escalated")).select(
        "id", "conversation_id", "user_id",
        F.coalesce(F.col("escalation_reason"), F.lit("unknown")).alias("reason"),
        left(F.col("query"), 200).alias("summary"),
        F.when(F.col("guardrail_triggered"), "high").otherwise("medium").alias("priority"),
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("assigned_to"),
        "created_at", F.lit(None).cast("timestamp_ntz").alias("resolved_at"))


def pipeline_violations(messages: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """P3 from raw messages: a violation needs no context, so no exchange."""
    q = _queries(messages.select("id", *KEY, "user_id", "role", "content", "created_at"))
    v = with_violation(q.where(blocked_predicate(rules)), "query", rules)
    return violations_from(v.withColumn("guardrail_triggered", F.col("violation_type").isNotNull()))


def pipeline_escalations(messages: DataFrame, rules: RuleSet = DEFAULT_RULES, strategy: str = "block") -> DataFrame:
    """P4 from raw messages: only the rules that an escalation depends on."""
    p = with_violation(prepare(messages, rules, strategy), "query", rules, keep_text=True)
    blocked = F.col("violation_type").isNotNull()
    reason = escalation_reason(F.col("_t"), F.col("n_prior"), F.col("n_frustrated"), blocked, rules)
    e = materialize(p.select("id", "conversation_id", "user_id", "query", "created_at", blocked.alias("guardrail_triggered"),
                             reason.alias("escalation_reason"), reason.isNotNull().alias("escalated")))
    return escalations_from(e)


# -- S5, S9, S10 --------------------------------------------------------------------------

def messages_with_replies(decisions: DataFrame) -> DataFrame:
    """The stored conversation: each user message, then its reply
    (agent_type set on the reply only)."""
    user = decisions.select(
        (F.col("id") * 2).alias("id"), "conversation_id", F.lit("user").alias("role"),
        F.col("query").alias("content"), F.lit(None).cast("string").alias("agent_type"), "created_at",
        F.col("turn").alias("turn"), F.lit(0).alias("seq"))
    reply = decisions.select(
        (F.col("id") * 2 + 1).alias("id"), "conversation_id", F.lit("assistant").alias("role"),
        F.col("response").alias("content"), "agent_type", "created_at",
        F.col("turn").alias("turn"), F.lit(1).alias("seq"))
    return user.unionByName(reply)


def conversation_headers(messages: DataFrame) -> DataFrame:
    """One header per conversation: owner, title = first user query[:80].

    ``min_by`` is a partial aggregate, so a hot conversation is combined
    map-side before the shuffle.
    """
    q = messages.where(F.col("role") == "user").select(
        "conversation_id", "user_id", "turn", "created_at", strip_ws(F.col("content")).alias("query"))
    return q.groupBy("conversation_id").agg(
        F.min("user_id").alias("user_id"),
        F.min_by(left(F.col("query"), 80), F.col("turn")).alias("title"),
        F.min("created_at").alias("created_at"),
    ).select(F.col("conversation_id").alias("id"), "user_id", F.lit("orchestrator").alias("initial_agent"),
             "title", F.lit("active").alias("status"), "created_at")


def conversation_state(decisions: DataFrame) -> DataFrame:
    """Agent of the latest decision and last update per conversation
    (``max_by`` / ``max``: partial aggregates)."""
    return decisions.groupBy("conversation_id").agg(
        F.max_by("agent_type", "turn").alias("agent_type"),
        F.max("created_at").alias("updated_at"),
        F.count(F.lit(1)).alias("n_decisions"),
    )


def conversations_table(messages: DataFrame, decisions: DataFrame) -> DataFrame:
    """conversations = headers (S9) updated with the latest state."""
    h = conversation_headers(messages)
    s = conversation_state(decisions).withColumnRenamed("conversation_id", "id")
    j = h.join(s, "id", "left")
    return j.select("id", "user_id", F.coalesce("agent_type", "initial_agent").alias("agent_type"), "title",
                    "status", "created_at", F.coalesce("updated_at", "created_at").alias("updated_at"))
