"""Oracle SQL views for the message pipeline.

Written as plain window-function SQL (``ROWS BETWEEN k PRECEDING AND 1
PRECEDING``), independent of the shift-aggregate plan on the Spark side.
"""

from __future__ import annotations

from parley.functions import replies
from parley.functions.rules import AGENT_FOR_INTENT, DEFAULT_RULES as R
from parley.plans.sql import lit, register_view
from parley.plans.sql_rules import (any_match, contains_any, intent_pick, intent_scores, map_case, quick_key,
                                    topic_pick)

K = R.frustration_frame


def template(text: str, **slots: str) -> str:
    """SQL concatenation of a reply template with its ``{slot}`` columns."""
    out, rest = [], text
    while True:
        hits = [(rest.find("{" + n + "}"), n) for n in slots if rest.find("{" + n + "}") >= 0]
        if not hits:
            out.append(lit(rest))
            break
        pos, name = min(hits)
        out.append(lit(rest[:pos]))
        out.append(slots[name])
        rest = rest[pos + len(name) + 2:]
    return "(" + " || ".join(out) + ")"


def moderated(reply: str) -> str:
    """G6 on an arbitrary reply expression."""
    return f"CASE WHEN {any_match(f'lower({reply})', R.output_moderation)} THEN {lit(replies.MODERATED_REPLY)} ELSE {reply} END"


def course_topic(t: str) -> str:
    return topic_pick(t, R.course_topics, len)


def hint_topic(t: str) -> str:
    return topic_pick(t, R.hint_topics, lambda _: 1)


def hint_reply_sql(topic: str) -> str:
    """Hint reply assembled in SQL from the hint table (not pre-filled)."""
    whens = []
    for name, d in replies.ASSIGNMENT_HINTS.items():
        body = template(replies.HINT_TEMPLATE, topic=lit(name), concept=lit(d["concept"]),
                        hints=lit("\n".join(d["hints"])), example=lit(d["similar_example"]))
        whens.append(f"WHEN {topic} = {lit(name)} THEN {body}")
    return "CASE " + " ".join(whens) + " END"


def agent_reply(agent: str, query: str, t: str) -> str:
    q100 = f"substring({query}, 1, 100)"
    course = f"COALESCE({map_case(course_topic(t), replies.KNOWLEDGE_BASE)}, {template(replies.COURSE_GENERIC, query=q100)})"
    assign = f"COALESCE({hint_reply_sql(hint_topic(t))}, {template(replies.ASSIGNMENT_GENERIC, query=q100)})"
    tech = f"COALESCE({map_case(quick_key(t), replies.QUICK_SOLUTIONS)}, {template(replies.TECHNICAL_GENERIC, query=q100)})"
    return (f"CASE {agent} WHEN 'course' THEN {course} WHEN 'assignment' THEN {assign} "
            f"WHEN 'technical' THEN {tech} ELSE {lit(replies.AGENT_ERROR_REPLY)} END")


FRUSTRATED = f"CASE WHEN role = 'user' AND {contains_any('lower(content)', R.frustration_words)} THEN 1 ELSE 0 END"

register_view("ctx", f"""
    SELECT conversation_id, turn,
           count(*) OVER w4 AS n_prior,
           CAST(COALESCE(sum({FRUSTRATED}) OVER w4, 0) AS BIGINT) AS n_frustrated,
           CASE WHEN lead(role) OVER w = 'assistant' THEN lead(created_at) OVER w END AS reply_at
    FROM chat_msg
    WINDOW w4 AS (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN {K} PRECEDING AND 1 PRECEDING),
           w AS (PARTITION BY conversation_id ORDER BY turn)""", ["chat_msg"])

register_view("dq", f"""
    SELECT g.*, c.n_prior, c.n_frustrated, c.reply_at, {intent_scores('g.t')}
    FROM gv g LEFT JOIN ctx c ON c.conversation_id = g.conversation_id AND c.turn = g.turn""", ["gv", "ctx"])

register_view("d1", f"""
    SELECT *, violation_type IS NOT NULL AS blocked,
           CASE WHEN {contains_any('t', R.escalation_phrases)} THEN 'student_request'
                WHEN {contains_any('t', R.grading_phrases)} THEN 'grading_dispute'
                WHEN COALESCE(n_prior, 0) >= {K} AND COALESCE(n_frustrated, 0) >= {R.frustration_min}
                     THEN 'repeated_frustration'
                WHEN violation_type IS NOT NULL THEN 'policy_violation' END AS escalation_reason,
           CASE WHEN violation_type IS NULL THEN {intent_pick()} END AS intent
    FROM dq""", ["dq"])

register_view("d2", f"""
    SELECT *, CASE WHEN blocked THEN 'orchestrator' WHEN escalation_reason IS NOT NULL THEN 'escalation'
                   ELSE COALESCE({map_case('intent', AGENT_FOR_INTENT)}, 'course') END AS agent_type
    FROM d1""", ["d1"])

register_view("d3", f"""
    SELECT *, CASE WHEN blocked THEN {map_case('violation_type', replies.VIOLATION_MESSAGES)}
                   WHEN escalation_reason IS NOT NULL
                        THEN COALESCE({map_case('escalation_reason', replies.ESCALATION_MESSAGES)},
                                      {lit(replies.ESCALATION_MESSAGES['student_request'])})
                   ELSE {moderated(agent_reply('agent_type', 'query', 't'))} END AS response
    FROM d2""", ["d2"])

register_view("dec", f"""
    SELECT id, conversation_id, turn, user_id, created_at, query,
           substring(sha256(CAST(conversation_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 8) AS request_id,
           blocked AS guardrail_triggered, violation_type, matched_pattern, severity, intent,
           escalation_reason IS NOT NULL AS escalated, escalation_reason, agent_type, response,
           (NOT blocked AND escalation_reason IS NULL AND response = {lit(replies.MODERATED_REPLY)}) AS output_filtered,
           epoch_ms(reply_at) - epoch_ms(created_at) AS response_time_ms
    FROM d3""", ["d3"])

register_view("pev", """
    SELECT id * 2 AS id,
           CASE WHEN guardrail_triggered THEN 'guardrail_trigger' WHEN escalated THEN 'escalation' ELSE 'query' END AS event_type,
           user_id,
           CASE WHEN guardrail_triggered THEN NULL ELSE agent_type END AS agent_type,
           CASE WHEN guardrail_triggered THEN '{"type":"' || violation_type || '"}'
                WHEN escalated THEN '{"reason":"' || escalation_reason || '"}' ELSE '{}' END AS metadata,
           CAST(NULL AS BIGINT) AS response_time_ms, created_at
    FROM dec
    UNION ALL
    SELECT id * 2 + 1, 'response', user_id, CASE WHEN guardrail_triggered THEN 'guardrails' ELSE agent_type END,
           '{}', response_time_ms, created_at
    FROM dec""", ["dec"])

register_view("pviol", """
    SELECT id, user_id, violation_type, substring(query, 1, 500) AS original_query, 'blocked' AS action_taken,
           severity, created_at
    FROM dec WHERE guardrail_triggered""", ["dec"])

register_view("pesc", """
    SELECT id, conversation_id, user_id, COALESCE(escalation_reason, 'unknown') AS reason,
           substring(query, 1, 200) AS summary, CASE WHEN guardrail_triggered THEN 'high' ELSE 'medium' END AS priority,
           'pending' AS status, CAST(NULL AS VARCHAR) AS assigned_to, created_at, CAST(NULL AS TIMESTAMP) AS resolved_at
    FROM dec WHERE escalated""", ["dec"])
