"""Message-classification queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import replies
from parley.functions.rules import DEFAULT_RULES as R
from parley.functions.text import first_match, strip_ws
from parley.operators import context as C
from parley.operators import guardrails as G
from parley.operators import quality as Q
from parley.operators import routing as RT
from parley.operators.escalation import escalation_reply
from parley.operators.ranking import number_rows
from parley.plans import dashboard as D
from parley.plans import pipeline as P
from parley.plans import sql_pipeline as SP
from parley.plans import sql_rules as SR
from parley.plans.catalog import query
from parley.plans.sql import lit, with_views
from parley.session import scratch_path
from parley.sources import driver, sinks

# -- G1-G4: one family each, over every user message -----------------------------


def _family_query(family: str):
    def build(t):
        _, _, pats = R.check(family)
        return t.user_queries.select("id", first_match(F.col("_t"), pats).alias("matched_pattern"))

    _, _, pats = R.check(family)
    sql = with_views(f"SELECT id, {SR.first_match('t', pats)} AS matched_pattern FROM gn", "gn")
    return build, sql


for _name, _fam in [("guard_injection", "prompt_injection"), ("guard_integrity", "academic_integrity"),
                    ("guard_toxicity", "toxicity"), ("guard_privacy", "privacy")]:
    _b, _s = _family_query(_fam)
    _b.__doc__ = f"G: the {_fam} check on every user message (matched text or NULL)."
    query(_name, _s)(_b)


@query("guard_first_violation", with_views(
    "SELECT id, user_id, query, violation_type, matched_pattern, severity FROM gv", "gv"))
def guard_first_violation(t):
    """First violation in check order, per user message."""
    q = t.user_queries.drop("_t")
    return G.with_violation(q, "query").select("id", "user_id", "query", "violation_type", "matched_pattern",
                                               "severity")


@query("output_moderation", with_views(f"""
    SELECT id, {SR.any_match('lower(content)', R.output_moderation)} AS output_filtered,
           {SP.moderated('content')} AS response
    FROM reply_msg""", "reply_msg"))
def output_moderation(t):
    """G6 over every assistant reply."""
    final, hit = G.moderate_output(F.col("content"))
    return t.assistant_replies.select("id", hit.alias("output_filtered"), final.alias("response"))


@query("document_moderation", with_views(f"""
    SELECT doc_id, {SR.any_match('lower(content)', R.output_moderation)} AS output_filtered,
           {SP.moderated('content')} AS response
    FROM doc_reply""", "doc_reply"))
def document_moderation(t):
    """G6 over the documents table taken as long replies (whole texts)."""
    final, hit = G.moderate_output(F.col("content"))
    return driver.document_replies(t.spark, t.sf_dir).select("doc_id", hit.alias("output_filtered"),
                                                             final.alias("response"))


# -- I1, I2, I3 ----------------------------------------------------------------------------

@query("intent_keywords", with_views(f"""
    SELECT id, s_course, s_assignment, s_technical, s_escalation, {SR.intent_pick()} AS intent
    FROM (SELECT id, {SR.intent_scores('t')} FROM gn)""", "gn"))
def intent_keywords(t):
    """Per-label keyword scores and the chosen intent."""
    u = t.user_queries
    scores = RT.intent_scores(F.col("_t"))
    out = u.select("id", *[s.alias(f"s_{lbl}") for lbl, s in scores])
    best = RT.argmax_label([(lbl, F.col(f"s_{lbl}")) for lbl, _ in scores])
    return out.select("*", F.when(best[1] > 0, best[0]).otherwise(F.lit("course")).alias("intent"))


def _model_label_sql():
    labels = "[" + ", ".join(lit(v) for v in driver.MODEL_LABELS) + "]"
    return with_views(f"""
        SELECT id, model_label, cleaned,
               CASE WHEN cleaned IN ({', '.join(lit(l) for l in R.intent_labels)}) THEN cleaned
                    ELSE {SR.intent_pick()} END AS intent
        FROM ml""", "gn", extra=[("ml", f"""
        SELECT id, {labels}[(conversation_id % 4) + 1] AS model_label,
               regexp_replace(lower({labels}[(conversation_id % 4) + 1]), '[^a-z]', '', 'g') AS cleaned,
               {SR.intent_scores('t')}
        FROM gn""")])


@query("intent_model_label", _model_label_sql())
def intent_model_label(t):
    """A model's label after cleanup if known, else the keyword intent."""
    u = driver.with_model_label(t.user_queries)
    return u.select("id", "model_label", RT.model_label_clean(F.col("model_label")).alias("cleaned"),
                    RT.model_intent(F.col("model_label"), F.col("_t")).alias("intent"))


def _failover_sql():
    ph = "[" + ", ".join(lit(v) for v in driver.REPLY_PHRASES) + "]"
    n = len(driver.REPLY_PHRASES)

    def ans(k):
        return f"{ph}[((conversation_id * 5 + turn + {k}) % {n}) + 1] || ' [{k}]'"

    q100 = "substring(query, 1, 100)"
    kb = (f"CASE WHEN agent = 'course' THEN {SR.map_case(SP.course_topic('t'), replies.KNOWLEDGE_BASE)} "
          f"WHEN agent = 'assignment' THEN {SP.hint_reply_sql(SP.hint_topic('t'))} "
          f"WHEN agent = 'technical' THEN {SR.map_case(SR.quick_key('t'), replies.QUICK_SOLUTIONS)} END")
    srch = (f"CASE WHEN search_answer IS NULL OR search_answer = '' THEN NULL "
            f"WHEN agent = 'course' THEN {SP.template(replies.SEARCH_COURSE, answer='search_answer')} "
            f"WHEN agent = 'assignment' THEN {SP.template(replies.SEARCH_ASSIGNMENT, answer='search_answer')} END")
    wiki = f"CASE WHEN agent = 'course' THEN {SP.template(replies.WIKI_COURSE, title='wiki_title', extract='wiki_extract')} END"
    generic = (f"CASE agent WHEN 'course' THEN {SP.template(replies.COURSE_GENERIC, query=q100)} "
               f"WHEN 'assignment' THEN {SP.template(replies.ASSIGNMENT_GENERIC, query=q100)} "
               f"WHEN 'technical' THEN {SP.template(replies.TECHNICAL_GENERIC, query=q100)} END")
    answers = "agent IN ('course', 'assignment', 'technical')"
    return with_views(f"""
        SELECT id, agent, {SP.moderated('answer')} AS answer, source,
               {SR.any_match('lower(answer)', R.output_moderation)} AS output_filtered
        FROM f2""", "gn", extra=[
        ("f0", f"""
            SELECT id, query, t,
                   COALESCE({SR.map_case(SR.intent_pick(), {k: k for k in R.intent_labels})}, 'course') AS agent,
                   CASE WHEN turn % 3 != 0 THEN {ans(0)} END AS answer_a,
                   CASE WHEN conversation_id % 2 != 0 THEN {ans(1)} END AS answer_b,
                   CASE WHEN conversation_id % 3 != 0 THEN {ans(2)} WHEN turn % 4 = 0 THEN '' END AS search_answer,
                   CASE WHEN conversation_id % 4 = 0 THEN 'Page ' || conversation_id END AS wiki_title,
                   CASE WHEN conversation_id % 8 = 0 THEN 'About turn ' || turn || '.' END AS wiki_extract
            FROM (SELECT *, {SR.intent_scores('t')} FROM gn)"""),
        ("f1", f"""
            SELECT *, CASE WHEN {answers} THEN answer_a END AS ma, CASE WHEN {answers} THEN answer_b END AS mb,
                   {srch} AS sr, {kb} AS kb, {wiki} AS wk, {generic} AS gen
            FROM f0"""),
        ("f2", f"""
            SELECT *, COALESCE(ma, mb, sr, kb, wk, gen, {lit(replies.AGENT_ERROR_REPLY)}) AS answer,
                   CASE WHEN ma IS NOT NULL THEN 'model_a' WHEN mb IS NOT NULL THEN 'model_b'
                        WHEN sr IS NOT NULL THEN 'search' WHEN kb IS NOT NULL THEN 'knowledge_base'
                        WHEN wk IS NOT NULL THEN 'encyclopedia'
                        WHEN gen IS NOT NULL THEN 'generic' ELSE 'error' END AS source
            FROM f1""")])


@query("answer_failover", _failover_sql())
def answer_failover(t):
    """I3 + G6: first available answer of the routed agent and its source."""
    u = driver.with_answers(t.user_queries).withColumn("agent", RT.agent_for_intent(RT.keyword_intent(F.col("_t"))))
    ans, src = RT.answer_failover(F.col("agent"), F.col("query"), F.col("_t"), *[F.col(c) for c in P.ANSWERS],
                                  wiki=tuple(F.col(c) for c in P.WIKI))
    u = u.select("id", "agent", ans.alias("_answer"), src.alias("source"))
    final, filt = G.moderate_output(F.col("_answer"))
    return u.select("id", "agent", final.alias("answer"), "source", filt.alias("output_filtered"))


# -- T1, T2, T3, R1, X9 ----------------------------------------------------------------------

@query("course_topic", with_views(f"SELECT id, {SP.course_topic('t')} AS topic FROM gn", "gn"))
def course_topic(t):
    """T1."""
    return t.user_queries.select("id", RT.course_topic(F.col("_t")).alias("topic"))


@query("hint_topic", with_views(f"SELECT id, {SP.hint_topic('t')} AS topic FROM gn", "gn"))
def hint_topic(t):
    """T2."""
    return t.user_queries.select("id", RT.hint_topic(F.col("_t")).alias("topic"))


@query("quick_solution", with_views(f"""
    SELECT id, {SR.quick_key('t')} AS quick_key,
           COALESCE({SR.map_case(SR.quick_key('t'), replies.QUICK_SOLUTIONS)},
                    {SP.template(replies.TECHNICAL_GENERIC, query='substring(query, 1, 100)')}) AS reply
    FROM gn""", "gn"))
def quick_solution(t):
    """T3 + technical reply."""
    u = t.user_queries
    k = RT.quick_key(F.col("_t"))
    return u.select("id", k.alias("quick_key"), RT.technical_reply(F.col("query"), k).alias("reply"))


@query("kb_reply", with_views(f"""
    SELECT id, agent, {SP.moderated(SP.agent_reply('agent', 'query', 't'))} AS reply
    FROM (SELECT *, COALESCE({SR.map_case(SR.intent_pick(), {k: k for k in R.intent_labels})}, 'course') AS agent
          FROM (SELECT *, {SR.intent_scores('t')} FROM gn))""", "gn"))
def kb_reply(t):
    """The routed agent's fallback reply (moderated)."""
    u = t.user_queries.withColumn("agent", RT.agent_for_intent(RT.keyword_intent(F.col("_t"))))
    return u.select("id", "agent", RT.agent_reply(F.col("agent"), F.col("query"), F.col("_t")).alias("reply"))


def _cleanup_sql():
    x = "lower(query)"
    for s in R.query_cleanup:
        x = SR.strip(f"replace({x}, {lit(s)}, '')")
    return with_views(f"SELECT id, CASE WHEN length(c) > 0 THEN c ELSE query END AS search_query "
                      f"FROM (SELECT id, query, {x} AS c FROM gn)", "gn")


@query("query_cleanup", _cleanup_sql())
def query_cleanup(t):
    """The cleaned search text (original when nothing is left)."""
    return t.user_queries.select("id", RT.search_query(F.col("query")).alias("search_query"))


# -- W1-W4, E1-E3 ----------------------------------------------------------------------------------

@query("frustration_window", with_views(f"""
    SELECT conversation_id, turn, n_prior, n_frustrated,
           n_prior >= {R.frustration_frame} AND n_frustrated >= {R.frustration_min} AS repeated_frustration
    FROM ctx""", "ctx"))
def frustration_window(t):
    """W1 for every message of every conversation."""
    f = C.frustration(t.chat_messages)
    return f.select("*", C.is_repeated_frustration(F.col("n_prior"), F.col("n_frustrated")).alias("repeated_frustration"))


@query("model_context", with_views(f"""
    SELECT m.conversation_id, m.turn, p.turn - greatest(m.turn - 6, 0) AS pos,
           CASE WHEN p.role = 'user' THEN 'user' ELSE 'model' END AS role, p.content
    FROM chat_msg m JOIN chat_msg p
      ON p.conversation_id = m.conversation_id AND p.turn BETWEEN m.turn - 6 AND m.turn - 1""", "chat_msg"))
def model_context(t):
    """Last 6 prior messages of every message, one row per item."""
    c = C.model_context(t.chat_messages)
    return c.select("conversation_id", "turn", F.posexplode("context").alias("pos", "item")).select(
        "conversation_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("item.role").alias("role"),
        F.col("item.content").alias("content"))


@query("handoff_summary", with_views("""
    SELECT g.conversation_id, g.turn, g.query AS student_query, g.turn AS conversation_length,
           p.turn - greatest(g.turn - 5, 0) AS pos, p.role, substring(p.content, 1, 200) AS content
    FROM gn g LEFT JOIN chat_msg p
      ON p.conversation_id = g.conversation_id AND p.turn BETWEEN g.turn - 5 AND g.turn - 1""", "gn", "chat_msg"))
def handoff_summary(t):
    """Hand-off record of every user message, one row per
    recent message (a message without context gives one row of NULLs)."""
    h = C.handoff_summary(t.chat_messages.select(*C.KEY, "role", "content"), strip_ws(F.col("content")))
    return h.select("conversation_id", "turn", "student_query", "conversation_length",
                    F.posexplode_outer("recent_messages").alias("pos", "item")).select(
        "conversation_id", "turn", "student_query", "conversation_length", F.col("pos").cast("long").alias("pos"),
        F.col("item.role").alias("role"), F.col("item.content").alias("content"))


@query("message_turns", with_views("""
    SELECT id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1 AS turn
    FROM msg""", "msg"))
def message_turns(t):
    """Turn numbers recomputed from time order (id tiebreak), a hot
    conversation split over tasks."""
    m = t.messages.drop("turn")
    return C.message_turns(m).select("id", "conversation_id", "turn")


@query("message_turns_range", with_views("""
    SELECT id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) - 1 AS turn
    FROM msg""", "msg"))
def message_turns_range(t):
    """W4 with the plan named: range partitioning splits a hot conversation."""
    return C.message_turns(t.messages.drop("turn"), "range").select("id", "conversation_id", "turn")


@query("message_recency", with_views("""
    SELECT id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) - 1 AS position
    FROM msg""", "msg"))
def message_recency(t):
    """O2 newest first: the place of every message counted from the latest."""
    m = t.messages.select("id", "conversation_id", "turn")
    return number_rows(m, ["conversation_id"], [F.col("turn").desc()], "position").select("id", "conversation_id", "position")


@query("dense_turns", with_views("""
    SELECT id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn * 2 + turn // 3, id) - 1 AS turn
    FROM msg""", "msg"))
def dense_turns(t):
    """W4 over gaps: turns with holes (0, 2, 4, 7, ...), numbered densely."""
    gapped = t.messages.withColumn("turn", F.col("turn") * 2 + F.floor(F.col("turn") / 3))
    return C.dense_turns(gapped).select("id", "conversation_id", "turn")


#: turns with gaps and repeats: 0, 0, 3, 3, 6, ... (equal turns in id order)
_GAPPED = ("gapped", """
    SELECT * REPLACE (turn // 2 * 3 AS turn), row_number() OVER (PARTITION BY conversation_id ORDER BY turn // 2 * 3, id) - 1 AS n
    FROM chat_msg""")


def _gapped(t):
    return t.chat_messages.withColumn("turn", F.floor(F.col("turn") / 2) * 3)


@query("frustration_window_gaps", with_views(f"""
    SELECT conversation_id, turn, id, count(*) OVER w AS n_prior,
           COALESCE(CAST(sum(CASE WHEN role = 'user' AND {SR.contains_any('lower(content)', R.frustration_words)} THEN 1 ELSE 0 END) OVER w AS BIGINT), 0) AS n_frustrated
    FROM gapped WINDOW w AS (PARTITION BY conversation_id ORDER BY n ROWS BETWEEN {R.frustration_frame} PRECEDING AND 1 PRECEDING)""",
                                           "chat_msg", extra=[_GAPPED]))
def frustration_window_gaps(t):
    """W1 over turns with gaps and repeats, a hot conversation spread over tasks."""
    return C.frustration(_gapped(t), strategy="order")


@query("model_context_gaps", with_views("""
    SELECT m.conversation_id, m.turn, m.id, p.n - greatest(m.n - 6, 0) AS pos,
           CASE WHEN p.role = 'user' THEN 'user' ELSE 'model' END AS role, p.content
    FROM gapped m JOIN gapped p ON p.conversation_id = m.conversation_id AND p.n BETWEEN m.n - 6 AND m.n - 1""",
                                      "chat_msg", extra=[_GAPPED]))
def model_context_gaps(t):
    """W2 over turns with gaps and repeats."""
    c = C.model_context(_gapped(t), strategy="order")
    return c.select("conversation_id", "turn", "id", F.posexplode("context").alias("pos", "item")).select(
        "conversation_id", "turn", "id", F.col("pos").cast("long").alias("pos"), "item.role", "item.content")


@query("handoff_summary_gaps", with_views(f"""
    SELECT g.conversation_id, g.turn, g.id, g.n AS conversation_length, p.n - greatest(g.n - 5, 0) AS pos, p.role,
           substring(p.content, 1, 200) AS content
    FROM (SELECT * FROM gapped WHERE role = 'user' AND length({SR.strip('content')}) > 0) g
    LEFT JOIN gapped p ON p.conversation_id = g.conversation_id AND p.n BETWEEN g.n - 5 AND g.n - 1""",
                                        "chat_msg", extra=[_GAPPED]))
def handoff_summary_gaps(t):
    """E3 / W3 / A17 over turns with gaps and repeats."""
    m = _gapped(t).select(*C.KEY, "id", "role", "content")
    h = C.handoff_summary(m, strip_ws(F.col("content")), strategy="order")
    return h.select("conversation_id", "turn", "id", "conversation_length",
                    F.posexplode_outer("recent_messages").alias("pos", "item")).select(
        "conversation_id", "turn", "id", "conversation_length", F.col("pos").cast("long").alias("pos"), "item.role", "item.content")


@query("escalation_decision", with_views(
    "SELECT id, escalated, escalation_reason, guardrail_triggered FROM dec", "dec"))
def escalation_decision(t):
    """E1 (with W1 context and the violation rule) per user message."""
    return t.decisions.select("id", "escalated", "escalation_reason", "guardrail_triggered")


@query("escalation_reply", with_views(f"""
    SELECT id, escalation_reason,
           COALESCE({SR.map_case('escalation_reason', replies.ESCALATION_MESSAGES)},
                    {lit(replies.ESCALATION_MESSAGES['student_request'])}) AS reply
    FROM dec WHERE escalated""", "dec"))
def escalation_reply_q(t):
    """Reply text for every escalated message."""
    e = P.pipeline_escalations(t.chat_messages)
    return e.select("id", F.col("reason").alias("escalation_reason"), escalation_reply(F.col("reason")).alias("reply"))


# -- P1-P4, S5, S9, S10, O1 -------------------------------------------------------------------------

@query("pipeline_decisions", with_views("SELECT * FROM dec", "dec"))
def pipeline_decisions(t):
    """One decision per user message."""
    return t.decisions


@query("pipeline_events", with_views("SELECT * FROM pev", "pev"))
def pipeline_events(t):
    """Analytics events emitted by the decisions."""
    return P.events_from(t.decisions)


@query("request_events", with_views(f"""
    SELECT 'ticket' AS source, request_id AS source_id, 'ticket_created' AS event_type, user_id,
           CAST(NULL AS VARCHAR) AS agent_type, '{{"category":"' || COALESCE(category, 'general') || '"}}' AS metadata, created_at
    FROM tkt_req WHERE COALESCE(length({SR.strip('subject')}), 0) > 0
    UNION ALL
    SELECT 'escalation', request_id, 'escalation', user_id, 'escalation',
           '{{"reason":"' || COALESCE(reason, 'student_request') || '"}}', created_at
    FROM esc_req
    UNION ALL
    SELECT 'message', id, event_type, user_id, agent_type, metadata, created_at FROM pev""", "tkt_req", "esc_req", "pev"))
def request_events(t):
    """All events - decisions, accepted tickets and manual escalations."""
    tickets = Q.ticket_intake(driver.ticket_requests(t.spark, t.sf_dir))
    manual = Q.manual_escalations(driver.escalation_requests(t.spark, t.sf_dir))
    e = P.all_events(t.decisions, tickets, manual)
    return e.select("source", "source_id", "event_type", "user_id", "agent_type", "metadata", "created_at")


@query("pipeline_violations", with_views("SELECT * FROM pviol", "pviol"))
def pipeline_violations(t):
    """P3 / S4."""
    return P.pipeline_violations(t.chat_messages)


@query("pipeline_escalations", with_views("SELECT * FROM pesc", "pesc"))
def pipeline_escalations(t):
    """P4 / S6."""
    return P.pipeline_escalations(t.chat_messages)


@query("messages_with_replies", with_views("""
    SELECT id * 2 AS id, conversation_id, 'user' AS role, query AS content, CAST(NULL AS VARCHAR) AS agent_type,
           created_at, turn, 0 AS seq FROM dec
    UNION ALL
    SELECT id * 2 + 1, conversation_id, 'assistant', response, agent_type, created_at, turn, 1 FROM dec""", "dec"))
def messages_with_replies(t):
    """The stored conversation, user turn then reply."""
    return P.messages_with_replies(t.decisions)


_HEADERS = ("hdr", """
    SELECT conversation_id AS id, min(user_id) AS user_id, 'orchestrator' AS initial_agent,
           arg_min(substring(query, 1, 80), turn) AS title, 'active' AS status, min(created_at) AS created_at
    FROM gq GROUP BY conversation_id""")


@query("conversation_headers", with_views("SELECT * FROM hdr", "gq", extra=[_HEADERS]))
def conversation_headers(t):
    """Conversation header from its first user query."""
    return P.conversation_headers(t.chat_messages)


_STATE = ("st", """
    SELECT conversation_id, arg_max(agent_type, turn) AS agent_type, max(created_at) AS updated_at,
           count(*) AS n_decisions
    FROM dec GROUP BY conversation_id""")


@query("conversation_state", with_views("SELECT * FROM st", "dec", extra=[_STATE]))
def conversation_state(t):
    """Latest agent and update time per conversation."""
    return P.conversation_state(t.decisions)


@query("recent_conversations", with_views("""
    SELECT *, rank <= 5 AS shown FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) AS rank FROM cv)
    WHERE rank <= 20""", "gq", "dec", extra=[_HEADERS, _STATE, ("cv", """
    SELECT h.id, h.user_id, COALESCE(s.agent_type, h.initial_agent) AS agent_type, h.title, h.status,
           h.created_at, COALESCE(s.updated_at, h.created_at) AS updated_at
    FROM hdr h LEFT JOIN st s ON s.conversation_id = h.id""")]))
def recent_conversations(t):
    """Each user's 20 latest conversations, top 5 flagged shown."""
    conv = P.conversations_table(t.chat_messages, t.decisions)
    return D.recent_conversations(conv, 20, 5)


# -- S3-S6, S13: the writers, read back -----------------------------------------------------------------

def _stored(t, name: str, write) -> DataFrame:
    """What a writer left after the same batch was written twice."""
    path = scratch_path(t.spark, f"stored/{name}-{uuid.uuid4().hex[:12]}")
    for _ in range(2):  # a retried job leaves one copy
        write(path)
    return t.spark.read.parquet(path).drop("batch_id", "event_date")


@query("stored_events", with_views("SELECT * FROM pev", "pev"))
def stored_events(t):
    """S3: logged events, partitioned by batch and day."""
    return _stored(t, "events", lambda path: sinks.log_events(P.events_from(t.decisions), path, 0))


@query("stored_violations", with_views("SELECT * FROM pviol", "pviol"))
def stored_violations(t):
    """Logged violations."""
    return _stored(t, "violations", lambda path: sinks.log_violations(P.pipeline_violations(t.chat_messages), path, 0))


@query("stored_messages", with_views("""
    SELECT id * 2 AS id, conversation_id, 'user' AS role, query AS content, CAST(NULL AS VARCHAR) AS agent_type,
           '{}' AS metadata, created_at FROM dec
    UNION ALL
    SELECT id * 2 + 1, conversation_id, 'assistant', response, agent_type, '{}', created_at FROM dec""", "dec"))
def stored_messages(t):
    """Stored conversation turns with their defaults."""
    return _stored(t, "messages", lambda path: sinks.store_messages(P.messages_with_replies(t.decisions), path, 0))


@query("stored_escalations", with_views("SELECT * FROM pesc", "pesc"))
def stored_escalations(t):
    """Stored escalations."""
    return _stored(t, "escalations", lambda path: sinks.store_escalations(P.pipeline_escalations(t.chat_messages), path, 0))


@query("loaded_once", with_views("SELECT * FROM crs", "crs"))
def loaded_once(t):
    """The second load finds the table stored and changes nothing."""
    path = scratch_path(t.spark, f"stored/courses-{uuid.uuid4().hex[:12]}")
    sinks.load_if_empty(t.courses, path)
    sinks.load_if_empty(t.courses.where("id % 2 = 0"), path)
    return t.spark.read.parquet(path)
