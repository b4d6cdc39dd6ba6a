"""Escalation decision and reply.

E1 order (first hit wins): an explicit request phrase, a grading-dispute
phrase, repeated frustration in the context frame (W1), then any input
violation.  A blocked message is therefore always escalated, and a request
phrase inside a blocked text wins over ``policy_violation``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import replies
from parley.functions.rules import DEFAULT_RULES, RuleSet
from parley.functions.text import col_, contains_any
from parley.operators.context import is_repeated_frustration


def escalation_reason(text_lower, n_prior: Column, n_frustrated: Column,
                      has_violation: Column | None = None, rules: RuleSet = DEFAULT_RULES) -> Column:
    """The escalation reason, NULL when the message is not escalated."""
    t = col_(text_lower)
    out = (F.when(contains_any(t, rules.escalation_phrases), F.lit("student_request"))
           .when(contains_any(t, rules.grading_phrases), F.lit("grading_dispute"))
           .when(is_repeated_frustration(n_prior, n_frustrated, rules), F.lit("repeated_frustration")))
    if has_violation is not None:
        out = out.when(has_violation, F.lit("policy_violation"))
    return out


def escalation_reply(reason) -> Column:
    """Reply text per reason; unknown reasons get the request text."""
    return F.coalesce(replies.lookup(replies.ESCALATION_MESSAGES, col_(reason)),
                      F.lit(replies.ESCALATION_MESSAGES["student_request"]))
