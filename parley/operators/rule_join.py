"""Keyword rules as a table: which texts contain which keywords.

For a rule table of any size (10^5 to 10^6 keywords) a nested loop is out of the
question.  Every keyword is indexed under one of its grams (three characters, or
the whole keyword if it is shorter), the one that occurs in the fewest texts.
Texts and index meet in an equi-join on the gram, and only these candidates are
checked with ``contains``.

A gram that many texts hold is split into parts by text, with its index rows in
every part; how many parts a gram needs is known from the counts that chose it.
Keywords one of whose grams occurs nowhere are dropped before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct grams of ``size`` characters of a text, in one pass (the
    group of a look-ahead at every place)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def text_grams(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, gram) of every text (id, text)."""
    both = F.concat(*[grams(F.col("text"), n) for n in sizes])
    return texts.select("id", F.explode(both).alias("gram"))


def rare_grams(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(rule_id, keyword, gram, n): the gram of each keyword that the fewest
    texts hold; keywords with a gram that no text holds are left out."""
    size = F.least(F.char_length("keyword"), F.lit(GRAM))
    found = F.when(size == GRAM, grams(F.col("keyword"), GRAM)).otherwise(F.array("keyword"))
    pieces = rules.select("rule_id", "keyword", F.explode(found).alias("gram"))
    seen = pieces.join(counts, "gram", "left")
    best = seen.groupBy("rule_id", "keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b"))
    return best.where("b.n > 0").select("rule_id", "keyword", "b.gram", "b.n")


def match_rules(texts: DataFrame, rules: DataFrame, parts_per_task: int = 4) -> DataFrame:
    """(id, rule_id) of every rule whose keyword a text contains.

    ``texts`` (id, text) with unique ids, ``rules`` (rule_id, keyword) with unique
    ids.  NULL texts contain nothing; NULL and empty keywords are in no text.
    """
    spark = texts.sparkSession
    rules = rules.select("rule_id", "keyword").where(F.char_length("keyword") > 0)
    texts = texts.select("id", "text").where(F.col("text").isNotNull())
    sizes = sorted(r[0] for r in rules.select(F.least(F.char_length("keyword"), F.lit(GRAM))).distinct().collect())  # 1 to 3
    if not sizes:
        return texts.limit(0).select("id").crossJoin(rules.limit(0).select("rule_id"))
    held = text_grams(texts, sizes)
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # no part of a gram is larger than this, so at most total / most grams have parts
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = total // (parts_per_task * tasks) + 1
    parts = F.ceil(F.col("n") / most).cast("int")
    index = rare_grams(rules, counts)
    frequent = F.broadcast(index.where(parts > 1).select("gram", parts.alias("parts")).distinct())
    salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")
    held = held.join(frequent, "gram", "left").select("id", "gram", salt.alias("part"))
    index = index.select("rule_id", "keyword", "gram", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    candidates = held.join(index, ["gram", "part"]).select("id", "rule_id", "keyword")
    found = candidates.join(texts, "id").where(F.contains("text", "keyword"))
    return found.select("id", "rule_id")


def label_by_rules(texts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """(id, label): the label whose matching rules weigh most; the smallest
    ``place`` among equals, ``default`` without a match (A14, A15).

    ``rules`` (rule_id, keyword, label, weight, place).
    """
    weights = rules.select("rule_id", "label", "weight", "place")
    scores = match_rules(texts, rules).join(weights, "rule_id").groupBy("id", "label").agg(F.sum("weight").alias("score"), F.min("place").alias("place"))
    best = scores.groupBy("id").agg(F.max(F.struct("score", (-F.col("place")).alias("o"), "label"))["label"].alias("label"))
    return texts.select("id").join(best, "id", "left").select("id", F.coalesce("label", F.lit(default)).alias("label"))
