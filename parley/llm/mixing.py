"""Mixing sources to target weights by entropy balancing (native).

A mix takes every document ``rate`` times on average.  Among all rates that
give each source its token target, entropy balancing picks the ones closest
to 1 in relative entropy over the tokens.  The convex dual is

    f(l) = sum_s  S_s * exp(l_s) - T_s * l_s

(``S_s`` tokens of the source, ``T_s`` its target), whose minimum gives the
exponentially tilted rates ``exp(l_s)``.  Source totals are sufficient
statistics, so the corpus is read once, pre-aggregated, and each Newton step
``l - f'/f''`` runs on the rows of the source table.

Rates become whole copies: ``floor(rate)`` copies for all, one more for the
documents whose keyed hash lies below the source's cut.  The cut comes from
two histograms of the hash (4096 bins, then 4096 bins inside the bin that is
crossed), so the words taken miss the target by about one document, no source
is ever sorted or gathered, and a rerun takes the same documents.

Defined results: null text has size 0; null is a source of its own, ordered
last; sources without words have target 0; an empty table gives no rows;
repeated rows are each a document (equal rows get equal copies); other
columns are ignored by the mix and kept by :func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import broadcast_if_small, materialize, n_words

BINS = 4096
#: sources up to which the one-row-per-source table is broadcast; above it
#: the table is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def _key(source: Column) -> Column:
    """A non-null join key that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _uniform(doc_id: Column, size: Column, seed: int) -> Column:
    """A keyed 48-bit hash of the document as an integer."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _bin1(u: Column) -> Column:
    return F.shiftright(u, 36)


def _bin2(u: Column) -> Column:
    return F.shiftright(u, 24).bitwiseAND(BINS - 1)


def source_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """``target`` per row of ``sources`` (source, skey, source_size).

    Weights repeat over the sources in code-point order, null last.  Targets
    are ``min(weight * level, max_rate * size)``; the level that spends
    ``share`` of all tokens is the fixed point of resharing the excess.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    pos = F.row_number().over(order) - 1
    every = W.partitionBy(F.lit(0))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "skey")
    upto = by_cap.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(pos, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(max_rate)) * F.col("source_size"))
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    t = t.withColumn("free_weight", F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))
    t = t.withColumn("free_budget", F.col("budget") - F.sum("cap").over(upto) + F.col("cap"))
    # in order of cap/weight, sources are capped until the level of the rest fits; that first level is the highest
    t = t.withColumn("level", F.when(F.col("free_budget") / F.col("free_weight") <= F.col("cap") / F.col("weight"), F.col("free_budget") / F.col("free_weight")))
    t = t.withColumn("level", F.max("level").over(every))
    return t.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("cap")))).select("source", "skey", "source_size", "target")


def newton_rates(targets: DataFrame, iterations: int = 60) -> DataFrame:
    """``rate = exp(l)`` with ``l`` from Newton steps on the dual, from 0."""
    size, goal = F.col("source_size").cast("double"), F.col("target")
    step = lambda l, _: l - (F.lit(1.0) - goal / (size * F.exp(l)))  # noqa: E731  f'/f''
    dual = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.lit(0.0), step)
    return targets.withColumn("rate", F.when((size > 0) & (goal > 0), F.exp(dual)).otherwise(F.lit(0.0)))


def _running(hist: DataFrame, bin_col: str) -> DataFrame:
    """Per source, tokens before each bin (``before``), bins in hash order."""
    w = W.partitionBy("skey").orderBy(bin_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    return hist.withColumn("before", F.sum("tokens").over(w) - F.col("tokens"))


def plan_mix(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_rate: float = 2.0, iterations: int = 60) -> DataFrame:
    """One row per source: target, rate, whole copies and the hash cut.

    ``sized`` has skey, source, size and u (see :func:`mix_sizes`).
    """
    sources = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rates = materialize(newton_rates(source_targets(sources, weights, share, max_rate), iterations))
    whole = F.floor(F.col("rate") + F.lit(1e-9))
    rates = rates.withColumn("whole", whole.cast("long")).withColumn("want", F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0)))
    wants = rates.select("skey", "want")
    small = F.broadcast if rates.count() <= BROADCAST_SOURCES else (lambda x: x)  # one row per source each
    # first histogram: the last bin that begins before the wanted tokens
    h1 = sized.groupBy("skey", _bin1(F.col("u")).alias("bin1")).agg(F.sum("size").alias("tokens"))
    h1 = _running(h1, "bin1").join(small(wants), "skey").where("tokens > 0 AND before < want")
    cut1 = h1.groupBy("skey").agg(F.max("bin1").alias("cut1"), F.max_by("before", "bin1").alias("before1"))
    # second histogram, inside that bin: the sub-bins nearest to the target
    inner = sized.join(small(cut1), "skey").where(_bin1(F.col("u")) == F.col("cut1"))
    h2 = inner.groupBy("skey", _bin2(F.col("u")).alias("bin2")).agg(F.sum("size").alias("tokens"), F.first("before1").alias("before1"))
    h2 = _running(h2, "bin2").join(small(wants), "skey")
    h2 = h2.where(F.col("before1") + F.col("before") + F.col("tokens") / 2 <= F.col("want"))
    cut2 = h2.groupBy("skey").agg(F.max("bin2").alias("cut2"))
    return (
        rates.join(cut1.select("skey", "cut1"), "skey", "left").join(cut2, "skey", "left")
        # everything up to and with sub-bin cut2 of bin cut1; no cut2: only the bins before cut1
        .withColumn("cut", F.when(F.col("cut1").isNull(), F.lit(0)).otherwise(F.col("cut1") * BINS + F.coalesce(F.col("cut2") + 1, F.lit(0))))
        .select("skey", "source_size", "target", "rate", "whole", "cut")
    )


def mix_sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with skey, size and the keyed hash u (reserved names)."""
    return docs.withColumn("skey", _key(F.col("source"))).withColumn("size", n_words(F.col("text"))).withColumn("u", _uniform(F.col("doc_id"), F.col("size"), seed))


def _join_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    plan = materialize(plan)
    copies = F.col("whole") + F.when(F.shiftright(F.col("u"), 24) < F.col("cut"), 1).otherwise(0)
    return sized.join(broadcast_if_small(plan, BROADCAST_SOURCES), "skey").withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_rate: float = 2.0, iterations: int = 60, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = materialize(mix_sizes(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", "skey", "size", "u"))
    out = _join_plan(sized, plan_mix(sized, weights, share, max_rate, iterations))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def apply_mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_rate: float = 2.0, iterations: int = 60, seed: int = 7) -> DataFrame:
    """The mixed documents: ``docs``' columns, then ``mix_size``, ``mix_target``
    and ``mix_copies`` (in place of columns of these names); documents taken 0
    times go."""
    sized = materialize(mix_sizes(docs.select("doc_id", "source", "text"), seed).select("source", "skey", "size", "u"))
    plan = plan_mix(sized, weights, share, max_rate, iterations)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    out = _join_plan(mix_sizes(rows, seed).select("row", "skey", "size", "u"), plan)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix_size", "mix_target", "mix_copies")]
    return out.where("copies > 0").select(*kept, F.col("size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"))
