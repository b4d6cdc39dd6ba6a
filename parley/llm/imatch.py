"""I-Match document fingerprints (native).

The lexicon holds the terms whose share of documents lies in a band of inverse
document frequency.  ``96`` randomised subsets of it (six sampling rates from
1/64 to 1/2048, sixteen subsets each, chosen by a hash of the term) give the
components of a fingerprint: the hash of the document's sorted distinct terms
in the subset.  Dense subsets tell near copies apart, sparse ones still match
when half of a document has changed; the likeness of two fingerprints is the
share of equal components among those that either has.

The lexicon has at most (mean distinct terms per document / ``min_share``)
terms however many documents there are, because its document frequencies add
up to at most all of them; it is broadcast after its size is checked.

Each document meets the next one (ascending doc_id) in one exchange: ids are
cut into ranges at approximate quantiles, a range is one window, and only the
last document of a range takes its neighbour from the table of first documents.
Everything after that - terms, lexicon look-up, components - stays in the
partition of the range.

Defined results: null text is the empty text; a text without terms in any
subset has the hash of its word list as fingerprint, and is like another such
text only if they are equal; null ids come first, equal ids in the order of
their text hash; the document after the last is the first (a single document
follows itself); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import broadcast_if_small, materialize

LEVELS, SLOTS, FIRST_RATE = 6, 16, 64
#: lexicon rows (term, subset) up to which the lexicon is broadcast
BROADCAST_ROWS = 1_000_000
_NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(text), _NOT_TERM), "")


def lexicon(docs: DataFrame, min_share: float, max_share: float) -> DataFrame:
    """(h, k): the hash of a term in the band and a subset that holds it."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("t")).select(F.xxhash64("t").alias("h"))
    band = terms.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(min_share * n, max_share * n))
    level = lambda i: F.pmod(F.xxhash64("h", F.lit(i)), F.lit(FIRST_RATE << i))
    subsets = F.array(*[F.when(level(i) < SLOTS, (level(i) + SLOTS * i).cast("int")) for i in range(LEVELS)])
    return band.select("h", F.explode(F.array_compact(subsets)).alias("k"))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, next_text, range and rn (the place in the range)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or []))])
    place = F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))), F.lit(0))
    order = F.struct("doc_id", F.xxhash64("text").alias("th"))
    docs = docs.withColumn("range", place).withColumn("o", order)
    firsts = docs.groupBy("range").agg(F.min_by("text", "o").alias("first_text"))
    every = W.orderBy("range")  # one row per range
    firsts = firsts.select("range", F.coalesce(F.lead("first_text").over(every), F.first("first_text").over(every)).alias("after"))
    w = W.partitionBy("range").orderBy("o")
    rows = docs.select("doc_id", "text", "range", F.lead("text").over(w).alias("lead"), F.row_number().over(w).alias("rn"))
    return rows.join(firsts, "range", "left").select("doc_id", "text", F.coalesce("lead", "after").alias("next_text"), "range", "rn")


def edit(text: Column, next_text: Column) -> Column:
    """The last half of ``text`` replaced by the beginning of the next."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(next_text, F.lit(1), half))


def _likeness(a: str, b: str) -> Column:
    same = F.sum(F.when(F.col(a) == F.col(b), 1).otherwise(0))
    either = F.sum(F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), 1).otherwise(0))
    return F.struct(same.alias("same"), either.alias("either"))


def fingerprint_edits(docs: DataFrame, min_share: float = 0.001, max_share: float = 0.25, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_text hash, fingerprints and likenesses of every
    document, its edited text and the next document."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lex = materialize(lexicon(docs, min_share, max_share))
    rows = with_next(docs, ranges).withColumn("edited", edit(F.col("text"), F.col("next_text")))
    plain = lambda c: F.xxhash64(words(F.col(c)))  # noqa: E731  for texts without a component
    about = F.struct("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[plain(c).alias(f"plain{i}") for i, c in enumerate(("text", "edited", "next_text"))])
    # one array per document: the terms of the three texts, and one entry that
    # carries the document itself
    none = F.lit(None).cast(rows.select(about.alias("x")).schema["x"].dataType)
    entry = lambda h, side, x: F.struct(h.alias("h"), F.lit(side).alias("side"), x.alias("about"))
    side = lambda c, i: F.transform(F.array_distinct(words(F.col(c))), lambda t: entry(F.xxhash64(t), i, none))
    entries = F.concat(side("text", 0), side("edited", 1), side("next_text", 2), F.array(entry(F.lit(0).cast("long"), 3, about)))
    terms = rows.select("range", "rn", F.explode(entries).alias("e")).select("range", "rn", "e.h", "e.side", "e.about")
    marker = spark.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("k"))
    hit = terms.join(broadcast_if_small(lex.where("h <> 0").unionByName(marker), BROADCAST_ROWS), "h")
    hashed = lambda i: F.xxhash64(F.sort_array(F.collect_set(F.when(F.col("side") == i, F.col("h")))))
    has = lambda i: F.max(F.when(F.col("side") == i, 1)) == 1
    parts = hit.groupBy("range", "rn", "k").agg(F.first("about", ignorenulls=True).alias("about"), *[F.when(has(i), hashed(i)).alias(f"c{i}") for i in range(3)])
    listed = lambda i: F.sort_array(F.collect_set(F.when(F.col(f"c{i}").isNotNull(), F.concat(F.lpad(F.hex("k"), 2, "0"), F.lit(":"), F.lower(F.lpad(F.hex(F.shiftrightunsigned(f"c{i}", 32)), 8, "0"))))))
    docs_ = parts.groupBy("range", "rn").agg(F.first("about", ignorenulls=True).alias("about"), listed(0).alias("l0"), listed(1).alias("l1"), _likeness("c0", "c1").alias("edited"), _likeness("c0", "c2").alias("next"))
    text = lambda i: F.when(F.size(f"l{i}") > 0, F.array_join(f"l{i}", " ")).otherwise(F.concat(F.lit("text:"), F.lower(F.lpad(F.hex(f"about.plain{i}"), 16, "0"))))
    like = lambda c, i: F.when(F.col(f"{c}.either") > 0, F.col(f"{c}.same") / F.col(f"{c}.either")).otherwise((F.col("about.plain0") == F.col(f"about.plain{i}")).cast("double"))
    return docs_.select("about.doc_id", "about.n_chars", "about.edited_sha256", text(0).alias("fingerprint"), text(1).alias("edited_fingerprint"), like("edited", 1).alias("near_edited"), like("next", 2).alias("near_next"))
