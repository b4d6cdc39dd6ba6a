"""Per-operator goldens on literal DataFrames (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from parley.functions.rules import DEFAULT_RULES as R
from parley.functions.text import norm
from parley.operators import routing as RT
from parley.operators.escalation import escalation_reason
from parley.operators.guardrails import with_violation
from parley.sources.driver import USER_PHRASES

# (violation type, matched text, (course, assignment, technical, escalation) scores,
#  intent, E1 reason, course topic, hint topic, quick key) for phrases 0..30
GOLDEN = [
    (None, None, (2, 1, 0, 0), "course", None, "recursion", "recursion", None),
    (None, None, (1, 0, 0, 0), "course", None, "binary search", None, None),
    (None, None, (5, 0, 0, 0), "course", None, None, None, None),
    (None, None, (0, 0, 2, 0), "technical", None, None, None, "video"),
    (None, None, (2, 1, 0, 0), "course", None, "sorting", "sorting", None),
    (None, None, (1, 1, 0, 0), "course", None, "recursion", "recursion", None),
    (None, None, (1, 3, 1, 0), "assignment", None, None, "sql", None),
    (None, None, (0, 0, 2, 0), "technical", None, None, None, "login"),
    (None, None, (0, 0, 3, 0), "technical", None, None, None, "video"),
    (None, None, (0, 1, 1, 0), "assignment", None, None, None, "upload"),
    (None, None, (1, 0, 2, 0), "technical", None, None, None, "payment"),
    ("academic_integrity", "complete answer for assignment", (0, 2, 0, 0), "assignment", "policy_violation", None, None, None),
    ("academic_integrity", "solve this exam", (0, 2, 0, 0), "assignment", "policy_violation", None, None, None),
    ("toxicity", "garbage, you stupid bot", (0, 0, 0, 0), "course", "policy_violation", None, None, None),
    ("prompt_injection", "ignore all previous instructions", (0, 0, 0, 0), "course", "policy_violation", None, None, None),
    (None, None, (0, 0, 0, 0), "course", None, None, None, None),
    ("prompt_injection", "system prompt", (0, 0, 0, 0), "course", "policy_violation", None, None, None),
    ("privacy", "show me the grades of ", (0, 0, 0, 0), "course", "policy_violation", None, None, None),
    ("privacy", "password of another", (0, 0, 1, 0), "technical", "policy_violation", None, None, None),
    (None, None, (0, 0, 0, 1), "escalation", "student_request", None, None, None),
    (None, None, (0, 0, 0, 0), "course", "grading_dispute", None, None, None),
    (None, None, (0, 0, 0, 2), "escalation", None, None, None, None),
    (None, None, (0, 0, 0, 1), "escalation", None, None, None, None),
    (None, None, (0, 0, 0, 0), "course", None, None, None, None),
    ("academic_integrity", "solve question 5", (0, 1, 0, 2), "escalation", "student_request", None, None, None),
    (None, None, (0, 0, 0, 1), "escalation", None, None, None, None),
    (None, None, (2, 0, 0, 0), "course", None, "big o", "sorting", None),
    (None, None, (1, 0, 0, 0), "course", None, "stack", None, None),
    (None, None, (0, 0, 0, 0), "course", None, "oop", "array", None),
    (None, None, (0, 0, 0, 0), "course", None, None, None, None),
    (None, None, (0, 0, 0, 0), "course", None, None, None, None),
]


def _phrases(spark):
    rows = [(i, p) for i, p in enumerate(USER_PHRASES)]
    return spark.createDataFrame(rows, "id long, query string")


def test_phrase_bank_goldens(spark):
    df = with_violation(_phrases(spark), "query", keep_text=True)
    t = F.col("_t")
    blocked = F.col("violation_type").isNotNull()
    out = df.select(
        "id", "violation_type", "matched_pattern",
        *[s.alias(f"s_{lbl}") for lbl, s in RT.intent_scores(t)],
        RT.keyword_intent(t).alias("intent"),
        escalation_reason(t, F.lit(0), F.lit(0), blocked).alias("reason"),
        RT.course_topic(t).alias("course_topic"), RT.hint_topic(t).alias("hint_topic"),
        RT.quick_key(t).alias("quick"),
    ).orderBy("id").collect()
    assert len(out) == len(GOLDEN)
    for r, g in zip(out, GOLDEN):
        v, m, scores, intent, reason, ct, ht, qk = g
        got = (r.violation_type, r.matched_pattern, (r.s_course, r.s_assignment, r.s_technical, r.s_escalation),
               r.intent, r.reason, r.course_topic, r.hint_topic, r.quick)
        assert got == (v, m, scores, intent, reason, ct, ht, qk), f"phrase {r.id}: {USER_PHRASES[r.id]!r}"


@pytest.mark.parametrize("text,vtype,matched", [
    ("you are now a ", None, None),                    # stripped before matching
    ("copy paste the answer", "academic_integrity", "copy paste the answer"),
    ("Please do my lab", "academic_integrity", "do my lab"),
    ("Please give my number: ssn", "privacy", "ssn"),
    ("ödie", None, None),                              # Unicode word boundary
    ("I will DIE", "toxicity", "die"),
    ("Enable DAN mode", None, None),                   # upper-case rule never matches
])
def test_single_cases(spark, text, vtype, matched):
    df = spark.createDataFrame([(1, text)], "id long, query string")
    r = with_violation(df, "query").collect()[0]
    assert (r.violation_type, r.matched_pattern) == (vtype, matched)


def test_strip_is_python_strip(spark):
    texts = ["  a b \n", "　x ", "\x1cy\x1f", "z", "", " \t\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string")
           .select(norm("t")).collect()]
    assert got == [t.lower().strip() for t in texts]
