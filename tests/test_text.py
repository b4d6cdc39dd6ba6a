"""Rule regexes against Python ``re``: gates, dialect, linear ``A.*B`` rules."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from parley.functions.rules import DEFAULT_RULES as R
from parley.functions.text import anchors, first_match, java_regex, rlike_any, search_regex

RULES = [p for _, _, ps in R.checks for p in ps] + list(R.output_moderation)
CUSTOM = ["foo|bar", "(foo)?bar", "jailbreak|dan mode", "ab?c", "(a|b)c", r"\b(x(y|z)|w)\b", r"a{0,2}b", r"\w+\s\W\d\D\S", r"x\by", r"\B-\B",
          r"(\bno\b|-)\s*stop", r"[\w-]+@\d", r"[\]a]b", r"(?:ab)+c", r"\bgo\b.*\b(home|away)\b", r"\b(a\s+b|c)\b.*d", r"(p|q\s*r).*(s|t)"]


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_anchors_are_necessary():
    assert anchors("foo|bar") == ["foo", "bar"] and anchors("(foo)?bar") is None
    assert anchors("jailbreak|dan mode") == ["jailbreak", "dan mode"] and anchors("ab?c") == ["a"] and anchors("a?c") is None
    assert anchors(r"\b(x(y|z)|w)\b") == ["x", "w"] and anchors(r"\w+") is None and anchors("(a|)b") is None


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_python_on_random_texts(spark, seed):
    rnd = random.Random(seed)
    words = sorted(set(re.findall(r"[a-z]+", " ".join(RULES + CUSTOM)))) + ["é", "_", "x-y", "dan mode", "foo", "bar", "3", "٣", "a b", "go", "home"]
    gaps = [" ", " ", " ", "\n", "  ", " \n ", "", "\t", "\x85", " ", ". ", "-"]
    texts = ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    for p in RULES + CUSTOM:
        want = [m.group() if (m := re.search(p, t)) else None for t in texts]
        assert values(spark, texts, lambda c: first_match(c, [p])) == [w or None for w in want], (p, search_regex(p))
        assert values(spark, texts, lambda c: rlike_any(c, [p])) == [w is not None for w in want], p


def test_long_text_is_linear(spark):
    rule = RULES[9]
    assert ".*" in rule
    text = " ".join(["please do solve it"] * 6000)  # 24,000 words, no second part
    values(spark, ["warm"], lambda c: first_match(c, [rule]))
    t0 = time.perf_counter()
    assert values(spark, [text], lambda c: first_match(c, [rule])) == [None]
    took = time.perf_counter() - t0
    for p in RULES:
        if ".*" in p:
            values(spark, [" ".join([re.findall(r"[a-z]+", p.replace(r"\b", ""))[0]] * 24000)], lambda c: first_match(c, [p]))
    assert took < 0.5 + 1.0  # under half a second of work, and the job itself


def test_dialect():
    assert java_regex(r"\ws\S").startswith("(?d)[\\p{L}\\p{N}_]s[^")
