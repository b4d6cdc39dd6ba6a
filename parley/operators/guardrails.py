"""Input guardrails and output moderation.

Every check is a column expression over the lower-cased, stripped text:
no Python, no join.  A family is a ``coalesce`` of per-rule extractions in
rule order, and each rule's regex runs only when one of its leading literal
words occurs (cheap ``contains`` gate), so a clean row usually runs no
regex at all.  The first family in catalog order that matched decides the
violation.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import replies
from parley.functions.rules import DEFAULT_RULES, RuleSet
from parley.functions.text import col_, first_match, left, norm, rlike_any, strip_ws


def check(text_norm, family: str, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Matched text of the family's first matching rule, else NULL."""
    _, _, pats = rules.check(family)
    return first_match(text_norm, pats)


def all_input_rules(rules: RuleSet = DEFAULT_RULES) -> list[str]:
    return [p for _, _, pats in rules.checks for p in pats]


def violation_message(vtype: Column) -> Column:
    """The reply shown for a blocked message, per violation type."""
    return replies.lookup(replies.VIOLATION_MESSAGES, vtype)


def context_key() -> str:
    """Cached columns belong to one Spark application (ids are never reused)."""
    from pyspark import SparkContext
    return SparkContext._active_spark_context.applicationId


@functools.lru_cache(maxsize=64)
def _violation_columns(rules: RuleSet, text: str, ctx: str):
    """Rule columns over the normalised-text column ``text`` (built once per
    rule set and Spark application: they are plain unresolved expressions)."""
    t = F.col(text)
    fams = [(name, sev, first_match(t, pats)) for name, sev, pats in rules.checks]
    matches = [m.alias(f"_m_{name}") for name, _, m in fams]
    vtype = sev = None
    for name, severity, _ in fams:
        hit = F.col(f"_m_{name}").isNotNull()
        vtype = F.when(hit, F.lit(name)) if vtype is None else vtype.when(hit, F.lit(name))
        sev = F.when(hit, F.lit(severity)) if sev is None else sev.when(hit, F.lit(severity))
    result = [vtype.alias("violation_type"),
              F.coalesce(*[F.col(f"_m_{n}") for n, _, _ in fams]).alias("matched_pattern"),
              sev.alias("severity")]
    return matches, result, [f"_m_{n}" for n, _, _ in fams]


def with_violation(df: DataFrame, text: str = "content", rules: RuleSet = DEFAULT_RULES,
                   keep_text: bool = False) -> DataFrame:
    """Add violation_type / matched_pattern / severity.

    The lower-cased, stripped text is computed once into ``_t``; each rule
    family is its own ``CASE`` column (keeps generated methods small, and a
    rule's regex runs only when its leading words occur); the first family
    in catalog order that matched decides the type.
    """
    matches, result, tmp = _violation_columns(rules, "_t", context_key())
    out = df.select("*", norm(F.col(text)).alias("_t")).select("*", *matches)
    out = out.select("*", *result).drop(*tmp)
    return out if keep_text else out.drop("_t")


@functools.lru_cache(maxsize=64)
def _any_rule_on_query(rules: RuleSet, ctx: str) -> Column:
    return rlike_any(norm(F.col("query")), all_input_rules(rules))


def violations_table(queries: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """guardrail_violations rows for every blocked user message.

    ``queries`` needs id, user_id, content, created_at.  The stored query
    is the stripped text cut to 500 characters; action is ``blocked``.
    """
    q = queries.select("id", "user_id", strip_ws(F.col("content")).alias("query"), "created_at")
    # cheap equivalent of "has a violation" on the base column (anchor-gated
    # rules); filtering on the derived columns would be pushed below the
    # projection and re-evaluate every rule in the filter
    q = q.where((F.length("query") > 0) & _any_rule_on_query(rules, context_key()))
    v = with_violation(q, "query", rules)
    return v.select(
        "id", "user_id", "violation_type",
        left(F.col("query"), 500).alias("original_query"),
        F.lit("blocked").alias("action_taken"),
        "severity", "created_at",
    )


def moderate_fixed(mapping: dict[str, str], rules: RuleSet = DEFAULT_RULES) -> dict[str, str]:
    """G6 applied once, at plan-build time, to fixed reply bodies.

    The bodies are constants, so their moderation is constant too; only
    replies with a data slot are moderated per row in Spark.
    """
    pats = [re.compile(p) for p in rules.output_moderation]
    return {k: (replies.MODERATED_REPLY if any(p.search(v.lower()) for p in pats) else v) for k, v in mapping.items()}


_SYNTAX = set("()|+*?{}[]^$")


def _chars_in_match(pattern: str) -> set[str] | None:
    """Characters a match of ``pattern`` can contain (None = any)."""
    if "." in pattern.replace("\\.", "") or "[^" in pattern or any(e in pattern for e in ("\\S", "\\W", "\\D")):
        return None
    out, i = set(), 0
    while i < len(pattern):
        if pattern[i] == "\\":
            nxt = pattern[i + 1]
            if nxt == "s":
                out.add(" ")  # stands for all whitespace
            elif nxt in "dbw":
                return None if nxt == "w" else out | set("0123456789") if nxt == "d" else out
            else:
                out.add(nxt)
            i += 2
            continue
        if pattern[i] not in _SYNTAX:
            out.add(pattern[i])
        i += 1
    return out


def _edge_is_barrier(ch: str, patterns) -> bool:
    if not ch or ch.isspace():
        return False
    for p in patterns:
        chars = _chars_in_match(p)
        if chars is None or ch in chars or ch.lower() in chars:
            return False
    return True


def moderate_template(template: str, slot: str, value: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """G6 of ``template`` filled with ``value`` at ``{slot}``.

    When the fixed parts cannot match and the characters at both edges
    of the slot cannot occur in any match (checked here, at plan time),
    every match lies inside the slot, so only the slot text is scanned.
    """
    reply = replies.fill(template, **{slot: value})
    pre, _, post = template.partition("{" + slot + "}")
    pats = [re.compile(p) for p in rules.output_moderation]
    fixed_clean = not any(p.search(pre.lower()) or p.search(post.lower()) for p in pats)
    if not (fixed_clean and _edge_is_barrier(pre[-1:], rules.output_moderation)
            and _edge_is_barrier(post[:1], rules.output_moderation)):
        return moderate_output(reply, rules)[0]
    hit = F.coalesce(rlike_any(F.lower(value), rules.output_moderation), F.lit(False))
    return F.when(hit, F.lit(replies.MODERATED_REPLY)).otherwise(reply)


def moderate_output(reply, rules: RuleSet = DEFAULT_RULES) -> tuple[Column, Column]:
    """(final reply, filtered flag).  Rules run on the lower-cased reply,
    not stripped; a hit replaces the whole reply with the fixed text."""
    hit = rlike_any(F.lower(col_(reply)), rules.output_moderation)
    hit = F.coalesce(hit, F.lit(False))
    final = F.when(hit, F.lit(replies.MODERATED_REPLY)).otherwise(col_(reply))
    return final, hit
