"""Plain-Python reference of the decision semantics, for small fixtures.

Processes the messages of each conversation one at a time in turn order,
with the prior messages as context -- the sequential definition that the
Spark plans (shift aggregates, windows, state) must reproduce.
"""

from __future__ import annotations

import re

from parley.functions import replies
from parley.functions.rules import DEFAULT_RULES as R


def first_violation(text: str):
    t = text.lower().strip()
    for name, severity, pats in R.checks:
        for p in pats:
            m = re.search(p, t)
            if m:
                return name, m.group(), severity
    return None


def keyword_intent(query: str) -> str:
    q = query.lower().strip()
    scores = {}
    for label, kws in R.intent_keywords:
        s = 0
        for kw in kws:
            if kw in q:
                s += 2 if len(kw.split()) > 1 else 1
        scores[label] = s
    best = max(scores, key=scores.get)
    return "course" if scores[best] == 0 else best


def topic(query: str, topics, weight):
    q = query.lower()
    best, best_score = None, 0
    for name, kws in topics:
        s = sum(weight(k) for k in kws if k in q)
        if s > best_score:
            best, best_score = name, s
    return best


def escalation(query: str, context: list[tuple[str, str]], violation) -> str | None:
    q = query.lower()
    if any(p in q for p in R.escalation_phrases):
        return "student_request"
    if any(p in q for p in R.grading_phrases):
        return "grading_dispute"
    if len(context) >= R.frustration_frame:
        n = sum(1 for role, content in context[-R.frustration_frame:]
                if role == "user" and any(w in content.lower() for w in R.frustration_words))
        if n >= R.frustration_min:
            return "repeated_frustration"
    if violation:
        return "policy_violation"
    return None


def moderate(reply: str) -> str:
    if any(re.search(p, reply.lower()) for p in R.output_moderation):
        return replies.MODERATED_REPLY
    return reply


def agent_reply(agent: str, query: str) -> str:
    if agent == "course":
        t = topic(query, R.course_topics, len)
        r = replies.KNOWLEDGE_BASE.get(t) if t else None
        r = r or replies.COURSE_GENERIC.replace("{query}", query[:100])
    elif agent == "assignment":
        t = topic(query, R.hint_topics, lambda _: 1)
        r = replies.HINT_REPLIES.get(t) if t else None
        r = r or replies.ASSIGNMENT_GENERIC.replace("{query}", query[:100])
    elif agent == "technical":
        q = query.lower()
        key = next((k for k in R.quick_keys if k in q), None)
        r = replies.QUICK_SOLUTIONS[key] if key else replies.TECHNICAL_GENERIC.replace("{query}", query[:100])
    else:
        r = replies.AGENT_ERROR_REPLY
    return moderate(r)


def decide(query: str, context: list[tuple[str, str]]) -> dict:
    v = first_violation(query)
    if v:
        reason = escalation(query, context, v)
        return {"violation_type": v[0], "matched_pattern": v[1], "intent": None, "agent_type": "orchestrator",
                "escalated": True, "escalation_reason": reason, "response": replies.VIOLATION_MESSAGES[v[0]]}
    intent = keyword_intent(query)
    reason = escalation(query, context, None)
    if reason:
        return {"violation_type": None, "matched_pattern": None, "intent": intent, "agent_type": "escalation",
                "escalated": True, "escalation_reason": reason,
                "response": replies.ESCALATION_MESSAGES.get(reason, replies.ESCALATION_MESSAGES["student_request"])}
    agent = intent if intent in dict(R.intent_keywords) else "course"
    return {"violation_type": None, "matched_pattern": None, "intent": intent, "agent_type": agent,
            "escalated": False, "escalation_reason": None, "response": agent_reply(agent, query)}


def classify(rows) -> dict[int, dict]:
    """rows: iterable of (id, conversation_id, turn, role, content)."""
    by_conv: dict[int, list] = {}
    for r in rows:
        by_conv.setdefault(r[1], []).append(r)
    out = {}
    for msgs in by_conv.values():
        msgs.sort(key=lambda r: r[2])
        context: list[tuple[str, str]] = []
        for mid, _, _, role, content in msgs:
            if role == "user" and content.strip():
                out[mid] = decide(content.strip(), context)
            context.append((role, content))
    return out
