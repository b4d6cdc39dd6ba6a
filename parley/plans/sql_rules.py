"""Oracle SQL for the rule-based views (guardrails, intent, topics, E1).

Hand-written CASE logic; only the rule constants come from the catalog.
"""

from __future__ import annotations

from parley.functions import replies
from parley.functions.rules import DEFAULT_RULES as R
from parley.functions.text import intent_weight
from parley.plans.sql import WS, lit, re2, register_view


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def first_match(t: str, patterns) -> str:
    whens = " ".join(f"WHEN regexp_matches({t}, {lit(re2(p))}) THEN regexp_extract({t}, {lit(re2(p))}, 1)"
                     for p in patterns)
    return f"CASE {whens} END"


def any_match(t: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, {lit(re2(p))})" for p in patterns) + ")"


def contains_any(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {lit(w)})" for w in words) + ")"


def score(t: str, words, weight=lambda w: 1) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({t}, {lit(w)}) THEN {weight(w)} ELSE 0 END" for w in words) + ")"


def map_case(key: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


CHECK_NAMES = [n for n, _, _ in R.checks]


def violation_columns(t: str) -> str:
    """m_<family> match columns for the normalised text ``t``."""
    return ", ".join(f"{first_match(t, pats)} AS m_{n}" for n, _, pats in R.checks)


def violation_type() -> str:
    return "CASE " + " ".join(f"WHEN m_{n} IS NOT NULL THEN {lit(n)}" for n in CHECK_NAMES) + " END"


def severity() -> str:
    return "CASE " + " ".join(f"WHEN m_{n} IS NOT NULL THEN {lit(s)}" for n, s, _ in R.checks) + " END"


def matched() -> str:
    return "COALESCE(" + ", ".join(f"m_{n}" for n in CHECK_NAMES) + ")"


def intent_scores(t: str) -> str:
    return ", ".join(f"{score(t, kws, intent_weight)} AS s_{lbl}" for lbl, kws in R.intent_keywords)


def intent_pick() -> str:
    """label with the max score, earlier label on ties, 'course' when all 0."""
    labels = [lbl for lbl, _ in R.intent_keywords]
    mx = "greatest(" + ", ".join(f"s_{l}" for l in labels) + ")"
    whens = " ".join(f"WHEN s_{l} = {mx} THEN {lit(l)}" for l in labels)
    return f"CASE WHEN {mx} = 0 THEN 'course' {whens} END"


def topic_pick(t: str, topics, weight) -> str:
    """first topic with the (strictly positive) maximum score, else NULL."""
    scores = {name: score(t, kws, weight) for name, kws in topics}
    mx = "greatest(" + ", ".join(scores.values()) + ")"
    whens = " ".join(f"WHEN {s} = {mx} THEN {lit(n)}" for n, s in scores.items())
    return f"CASE WHEN {mx} > 0 THEN CASE {whens} END END"


def quick_key(t: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({t}, {lit(k)}) THEN {lit(k)}" for k in R.quick_keys) + " END"


# guardrail view over the spliced user turns: gv has query (stripped),
# t (lower-cased, stripped), the four m_<family> columns, violation_type,
# matched_pattern and severity
register_view("gq", f"""
    SELECT id, conversation_id, turn, user_id, created_at, {strip('content')} AS query FROM chat_q""",
              ["chat_q"])
register_view("gn", f"SELECT *, {strip('lower(query)')} AS t FROM gq WHERE length(query) > 0", ["gq"])
register_view("gm", f"SELECT *, {violation_columns('t')} FROM gn", ["gn"])
register_view("gv", f"""
    SELECT *, {violation_type()} AS violation_type, {matched()} AS matched_pattern, {severity()} AS severity
    FROM gm""", ["gm"])
register_view("viol", """
    SELECT id, user_id, violation_type, substring(query, 1, 500) AS original_query,
           'blocked' AS action_taken, severity, created_at
    FROM gv WHERE violation_type IS NOT NULL""", ["gv"])

VIOLATION_MESSAGE = lambda key: map_case(key, replies.VIOLATION_MESSAGES)
