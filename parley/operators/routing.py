"""Intent routing, topic lookup and reply selection.

All keyword logic is substring containment on the lower-cased text
(``"app"`` hits ``"approach"``, like the original), expressed as sums of
``CASE WHEN contains(...)`` terms; arg-max with a declared tie order is a
``greatest`` over ``struct(score, -ordinal, label)``.  Lookups into the
fixed knowledge tables are literal maps in the projection, so routing adds
no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import replies
from parley.functions.rules import AGENT_FOR_INTENT, AGENT_LABELS, DEFAULT_RULES, RuleSet
from parley.functions.text import (argmax_label, col_, contains_any, intent_weight, keyword_score, left,
                                   model_label_clean, query_cleanup)


# -- I1, I2 -----------------------------------------------------------------------

def intent_scores(text_lower, rules: RuleSet = DEFAULT_RULES) -> list[tuple[str, Column]]:
    return [(lbl, keyword_score(text_lower, kws, intent_weight)) for lbl, kws in rules.intent_keywords]


def keyword_intent(text_lower, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Best-scoring label, earlier label on ties, ``course`` when all 0."""
    label, score = argmax_label(intent_scores(text_lower, rules))
    return F.when(score > 0, label).otherwise(F.lit("course"))


def model_intent(model_label, text_lower, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Accept a model's label after cleanup (X8) when it is a known
    label; otherwise fall back to the keyword intent."""
    cleaned = model_label_clean(model_label)
    return F.when(cleaned.isin(*rules.intent_labels), cleaned).otherwise(keyword_intent(text_lower, rules))


# -- T1, T2, T3 -----------------------------------------------------------------------

def _topic(text_lower, topics, weight) -> Column:
    label, score = argmax_label([(name, keyword_score(text_lower, kws, weight)) for name, kws in topics])
    return F.when(score > 0, label)


def course_topic(text_lower, rules: RuleSet = DEFAULT_RULES) -> Column:
    """score = total length of contained keywords; strict max, first wins."""
    return _topic(text_lower, rules.course_topics, len)


def hint_topic(text_lower, rules: RuleSet = DEFAULT_RULES) -> Column:
    """score = number of contained keywords."""
    return _topic(text_lower, rules.hint_topics, lambda _: 1)


def quick_key(text_lower, rules: RuleSet = DEFAULT_RULES) -> Column:
    """First contained troubleshooting key."""
    out = None
    for k in rules.quick_keys:
        c = contains_any(text_lower, [k])
        out = F.when(c, F.lit(k)) if out is None else out.when(c, F.lit(k))
    return out


# -- J7, J8 -------------------------------------------------------------------------------

def agent_for_intent(intent) -> Column:
    """Agent serving an intent; unknown -> course."""
    return F.coalesce(replies.lookup(AGENT_FOR_INTENT, col_(intent)), F.lit("course"))


def agent_label(agent_type) -> Column:
    """Display label of an agent type; unknown types show as-is."""
    return F.coalesce(replies.lookup(AGENT_LABELS, col_(agent_type)), col_(agent_type))


# -- R1, J4, J5, G6 ----------------------------------------------------------------------------

def _moderated(mapping):
    from parley.operators.guardrails import moderate_fixed
    return moderate_fixed(mapping)


def _templated(template: str, query) -> Column:
    from parley.operators.guardrails import moderate_template
    return moderate_template(template, "query", left(query, 100))


def course_reply(query, topic) -> Column:
    """Knowledge-base body for the topic, else the generic study reply."""
    return F.coalesce(replies.lookup(_moderated(replies.KNOWLEDGE_BASE), col_(topic)),
                      _templated(replies.COURSE_GENERIC, query))


def assignment_reply(query, topic) -> Column:
    """Hint reply for the topic, else the generic step-by-step reply."""
    return F.coalesce(replies.lookup(_moderated(replies.HINT_REPLIES), col_(topic)),
                      _templated(replies.ASSIGNMENT_GENERIC, query))


def technical_reply(query, key) -> Column:
    """Quick fix for the first matched key, else generic troubleshooting."""
    return F.coalesce(replies.lookup(_moderated(replies.QUICK_SOLUTIONS), col_(key)),
                      _templated(replies.TECHNICAL_GENERIC, query))


def agent_reply(agent, query, text_lower, rules: RuleSet = DEFAULT_RULES) -> Column:
    """R1 + G6: the moderated fallback answer of the routed agent.

    The escalation agent has no answer generator, so routing a plain
    query to it yields the apology text.  Only the chosen branch is
    evaluated; fixed bodies were moderated at plan-build time, templated
    ones (carrying the query) are moderated per row.
    """
    a = col_(agent)
    return (F.when(a == "course", course_reply(query, course_topic(text_lower, rules)))
            .when(a == "assignment", assignment_reply(query, hint_topic(text_lower, rules)))
            .when(a == "technical", technical_reply(query, quick_key(text_lower, rules)))
            .otherwise(F.lit(replies.AGENT_ERROR_REPLY)))


# -- I3 ---------------------------------------------------------------------------------------

def answer_failover(agent, query, text_lower, answer_a, answer_b, search, rules: RuleSet = DEFAULT_RULES,
                    wiki: tuple | None = None):
    """(first available answer, source step), before output moderation.

    Order: model A, model B (any answering agent), then the agent's own
    fallbacks: course -> web search, knowledge base, encyclopedia, generic
    text; assignment -> web search, hints, generic; technical -> quick fix,
    generic.  The escalation agent has no answer generator (apology text).
    An empty search answer is none.  ``wiki`` is (title, extract) of the
    encyclopedia's best page for :func:`search_query`, NULL where it has none.
    Each step is a struct of answer and source, so an answer expression is
    there once; callers project the answer into a column and moderate that.
    """
    a, tl = col_(agent), text_lower
    step = lambda body, source: F.when(body.isNotNull(), F.struct(body.alias("answer"), F.lit(source).alias("source")))
    found = F.nullif(col_(search), F.lit(""))
    common = [step(col_(answer_a), "model_a"), step(col_(answer_b), "model_b")]
    ask = left(query, 100)
    course = common + [step(replies.fill(replies.SEARCH_COURSE, answer=found), "search"),
                       step(replies.lookup(replies.KNOWLEDGE_BASE, course_topic(tl, rules)), "knowledge_base")]
    if wiki is not None:
        course.append(step(replies.fill(replies.WIKI_COURSE, title=col_(wiki[0]), extract=col_(wiki[1])), "encyclopedia"))
    course.append(step(replies.fill(replies.COURSE_GENERIC, query=ask), "generic"))
    assignment = common + [step(replies.fill(replies.SEARCH_ASSIGNMENT, answer=found), "search"),
                           step(replies.lookup(replies.HINT_REPLIES, hint_topic(tl, rules)), "knowledge_base"),
                           step(replies.fill(replies.ASSIGNMENT_GENERIC, query=ask), "generic")]
    technical = common + [step(replies.lookup(replies.QUICK_SOLUTIONS, quick_key(tl, rules)), "knowledge_base"),
                          step(replies.fill(replies.TECHNICAL_GENERIC, query=ask), "generic")]
    error = F.struct(F.lit(replies.AGENT_ERROR_REPLY).alias("answer"), F.lit("error").alias("source"))
    chosen = (F.when(a == "course", F.coalesce(*course, error)).when(a == "assignment", F.coalesce(*assignment, error))
              .when(a == "technical", F.coalesce(*technical, error)).otherwise(error))
    return chosen["answer"], chosen["source"]


def search_query(query, rules: RuleSet = DEFAULT_RULES) -> Column:
    """The cleaned search text sent to the encyclopedia step."""
    return query_cleanup(query, rules.query_cleanup)
