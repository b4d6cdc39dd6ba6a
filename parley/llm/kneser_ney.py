"""Quality classifier: interpolated modified Kneser-Ney perplexity.

1. *Trusted text*: documents labelled quality 1, dealt in two by a hash of the
   id.  The model is fitted on one half, at most ``max_trusted`` documents of it
   (a bounded, documented sample); thresholds are read off all of the other.
2. *Counts*: tasks count the n-grams of their documents over all code points,
   Spark adds them up.  Lower orders count distinct predecessors.
3. *Smoothing*: discounts D1, D2, D3+ per order from the counts of counts; joins
   with the totals of the contexts give every n-gram its discounted mass, and
   every context the mass it leaves to the shorter n-gram.
4. *Perplexity by sharded joins*: documents are dealt to blocks, a block asks the
   shards of the model for its distinct n-grams of every order
   (:mod:`parley.llm.blocks`), and adds up its documents from the answers:

       p(w | abc) = mass(abcw) + left(abc) * p(w | bc),  ...,  down to uniform

   Neither the alphabet nor the model has to fit anywhere as a whole.
5. *Thresholds*: documents above the ``quantile`` of the perplexity of the
   trusted documents of their language are rejected.  Short texts are drawn
   towards their language's mean, as if ``shrink`` more symbols had been read.

Masses travel as 16-bit logarithms (a relative error of 3e-4).  n-grams are named
by 64-bit hashes between blocks and shards.

Defined results: null and empty texts have no symbols, the mean perplexity of
their language, and are kept; languages with fewer than ``min_trusted`` trusted
documents (null is one) use the quantile of all; without trusted documents all
are kept; several labels of one document count as trusted if any is 1; ties
with the threshold are kept; repeated rows are judged each; all columns are
kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from parley.llm import blocks
from parley.llm.common import block_count, broadcast_if_small, corpus_size, materialize, mix
from parley.llm.trie_lm import decode

#: the symbol before a text, no code point
BEGIN = 0x110000
MANY_LANGUAGES = 10_000  # names beyond which their table is not broadcast
STEP = 4096.0  # codes per power of ten


def encode(mass: np.ndarray) -> np.ndarray:
    """16-bit codes of -log10, to the nearest step; 0xFFFF: none."""
    with np.errstate(divide="ignore"):
        c = np.rint(-np.log10(mass) * STEP)
    return np.where(mass > 0, np.clip(c, 0, 0xFFFE), 0xFFFF).astype(np.uint16)


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)


def _number(keys: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (below ``room``), and each key's place among them."""
    if room > 1 << 24:
        distinct, place = np.unique(keys, return_inverse=True)
        return distinct, place.astype(np.int32)
    seen = np.zeros(room, bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[keys]


class Grams:
    """The distinct n-grams of some texts, up to ``order`` symbols.

    ``symbol[n]``, ``prefix[n]`` and ``suffix[n]`` describe the n-grams of n + 1
    symbols: the last symbol, and the places of the first n and the last n of
    them among the shorter ones.  ``of`` is the place of the longest n-gram that
    ends at each symbol, ``lengths`` how many symbols each text has.
    """

    def __init__(self, texts: list[str | None], order: int):
        begin = np.full(order - 1, BEGIN, np.int32)
        points = [_points(t) for t in texts]
        self.lengths = np.array([len(p) for p in points], np.int64)
        flat = np.concatenate([x for p in points for x in (begin, p)]) if points else begin
        # how many symbols of its own text, up to order - 1, are before each symbol
        before = np.full(len(flat), order - 1, np.int8)
        heads = np.cumsum(self.lengths + order - 1) - self.lengths - order + 1 if points else np.zeros(1, np.int64)
        for i in range(order - 1):
            before[heads + i] = i
        real = before == order - 1
        letters, first = _number(flat, BEGIN + 1)
        self.symbol, self.prefix, self.suffix = [letters.astype(np.int64)], [np.zeros(len(letters), np.int64)], [np.zeros(len(letters), np.int64)]
        size, shorter = len(letters), first
        for n in range(1, order):
            at = np.flatnonzero(before >= n)  # no n-gram reaches into another text
            keys = shorter[at - 1].astype(np.int64) * size + first[at]
            distinct, place = _number(keys, len(self.symbol[-1]) * size)
            suffix = np.zeros(len(distinct), np.int64)
            suffix[place] = shorter[at]
            self.symbol.append(letters[distinct % size] if len(letters) else distinct)
            self.prefix.append(distinct // max(size, 1))
            self.suffix.append(suffix)
            if n < order - 1:
                shorter = np.zeros(len(flat), np.int32)
                shorter[at] = place
            else:
                self.of = place
        if order == 1:
            self.of = first[real]

    def columns(self, n: int) -> list[np.ndarray]:
        """The symbols of the n-grams of ``n`` symbols, first to last."""
        out, at = [], np.arange(len(self.symbol[n - 1]))
        for m in range(n - 1, -1, -1):
            out.insert(0, self.symbol[m][at])
            at = self.prefix[m][at]
        return out

    def keys(self) -> list[np.ndarray]:
        """The hashes of the n-grams of every order."""
        out = [mix(self.symbol[0].astype(np.uint64), 1)]
        for symbol, prefix in zip(self.symbol[1:], self.prefix[1:]):
            out.append(mix(out[-1][prefix], symbol.astype(np.uint64)))
        return out


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """The same hash from columns of symbols."""
    key = mix(columns[0].astype(np.uint64), 1)
    for c in columns[1:]:
        key = mix(key, c.astype(np.uint64))
    return key


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, fit): the documents labelled good, dealt in two."""
    good = labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct()
    return good.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)) == 0)


def count_grams(texts: DataFrame, order: int, chunk: int = 500) -> DataFrame:
    """(w1, ..., c): the n-grams of the highest order, counted."""
    names = [f"w{i}" for i in range(1, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                grams = Grams(b.column(0).slice(at, chunk).to_pylist(), order)
                c = np.bincount(grams.of, minlength=len(grams.symbol[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)) for w in grams.columns(order)] + [pa.array(c.astype(np.int64))], names=[*names, "c"])

    counted = texts.select("text").mapInArrow(run, ", ".join(f"{w} int" for w in names) + ", c long")
    return counted.groupBy(*names).agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    n = {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def smooth(counts: DataFrame, order: int) -> tuple[DataFrame, float, int]:
    """The n-grams of all orders (w1, ..., padded with -1) with ``mass``, their
    own discounted share of their context, and ``left``, what they leave to
    shorter n-grams as a context; what the empty context leaves; the symbols."""
    names = [f"w{i}" for i in range(1, order + 1)]
    by_order = [counts]
    for n in range(order - 1, 0, -1):  # distinct predecessors
        shorter = by_order[0].groupBy(*[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, n + 1)])
        by_order.insert(0, materialize(shorter.agg(F.count(F.lit(1)).alias("c"))))
    masses, lefts = [], []
    for n, table in enumerate(by_order, 1):
        d1, d2, d3 = discounts(table)
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = names[:n - 1]
        total = table.groupBy(*context).agg(F.sum("c").alias("total"), F.sum(d).alias("free"))
        lefts.append(total.select(*context, (F.col("free") / F.col("total")).alias("left")))
        if context:
            table, whole = table.join(total, context), F.col("total")
        else:
            one = total.first()
            rest, whole = one["free"] / one["total"] if one["total"] else 1.0, F.lit(one["total"])
        masses.append(table.select(*names[:n], (F.greatest(F.col("c") - d, F.lit(0.0)) / whole).alias("mass")))
    parts = []
    for n, mass in enumerate(masses, 1):
        pad = [F.lit(-1).alias(w) for w in names[n:]]
        row = mass.join(lefts[n], names[:n], "full") if n < order else mass.withColumn("left", F.lit(None).cast("double"))
        parts.append(row.select(*names[:n], *pad, F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("left", F.lit(1.0)).alias("left")))
    return reduce(DataFrame.unionByName, parts), rest, by_order[0].count()


def sharded_model(grams: DataFrame, order: int, n_shards: int) -> DataFrame:
    """(shard, key, mass, left) of the model's n-grams, the masses as codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.stack([b.column(i).to_numpy() for i in range(order)]).astype(np.int64)
            n = (w >= 0).sum(axis=0)
            key = np.zeros(b.num_rows, np.uint64)
            for k in range(1, order + 1):
                key[n == k] = gram_keys(list(w[:k, n == k]))
            shard = blocks.even_shards(n_shards)(key).astype(np.int64)
            codes = [pa.array(encode(b.column(order + i).to_numpy()).astype(np.int32)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.view(np.int64)), *codes], names=["shard", "key", "mass", "left"])

    return grams.mapInArrow(run, "shard long, key long, mass int, left int")


def _texts(rows: pa.Table, column: str) -> list[str | None]:
    return rows.column(column).to_pylist()


def _ask(rows: pa.Table, column: str, order: int, n_shards: int):
    keys = np.unique(np.concatenate(Grams(_texts(rows, column), order).keys()))
    for shard, lo, hi in blocks.ranges(keys, blocks.even_shards(n_shards)):
        yield 0, shard, blocks.pack_sorted(keys[lo:hi])


def _answer(key, asked, model):
    """The codes (mass, left) of each asked n-gram; none: 0 and 1."""
    known = model.column("key").to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, codes = known[order], [model.column(c).to_numpy()[order] for c in ("mass", "left")]
    out = []
    for body in asked.column("body").to_pylist():
        keys = blocks.unpack_sorted(body)
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        both = [np.where(hit, c[at], none) if len(known) else np.full(len(keys), none) for c, none in zip(codes, (0xFFFF, 0))]
        out.append(blocks.pack(both[0].astype(np.uint64) << np.uint64(16) | both[1].astype(np.uint64)))
    return pa.table({"kind": asked.column("kind"), "shard": asked.column("shard"), "block": asked.column("block"), "body": pa.array(out, pa.binary())})


def _log_probabilities(grams: Grams, mass: list[np.ndarray], left: list[np.ndarray], rest: float, uniform: float) -> np.ndarray:
    """log10 p of the longest n-grams, from the shortest up."""
    p = mass[0] + rest * uniform
    for n in range(1, len(mass)):
        p = mass[n] + left[n - 1][grams.prefix[n]] * p[grams.suffix[n]]
    return np.log10(p)


class Model:
    """A trained model, as a table of its n-grams."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_trusted: int, order: int):
        chosen = trusted_ids(labels).where("fit").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_trusted)
        texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").where("text IS NOT NULL")
        counts = materialize(count_grams(texts, order))
        grams, self.rest, symbols = smooth(counts, order)
        self.grams, self.order, self.uniform = materialize(grams), order, 1.0 / (symbols + 1)

    def add(self, docs: DataFrame, keep: list[str], block_mb: int = 6) -> DataFrame:
        """The columns ``keep`` of ``docs`` (doc_id, text, ...) as c0, c1, ...,
        with kn_logp (sum of log10 p) and kn_n (symbols)."""
        order, rest, uniform = self.order, self.rest, self.uniform
        n_blocks = block_count(docs.sparkSession, corpus_size(docs)[1], block_mb)
        at = docs.columns.index("text")
        named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        text, place = f"c{at}", [f"c{docs.columns.index(c)}" for c in keep]
        dealt = blocks.deal(named, n_blocks, by=(f"c{docs.columns.index('doc_id')}", text))
        asked = blocks.ask(dealt, lambda rows, _: _ask(rows, text, order, n_blocks))
        model = sharded_model(self.grams, order, n_blocks)
        answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_answer, "kind int, shard long, block int, body binary")
        fields = [named.schema[c] for c in place]
        schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [StructField("kn_logp", DoubleType()), StructField("kn_n", LongType())])

        def score(rows: pa.Table, given: dict) -> pa.Table:
            grams = Grams(_texts(rows, text), order)
            keys = grams.keys()
            asked_keys, where = np.unique(np.concatenate(keys), return_inverse=True)
            codes = np.zeros(len(asked_keys), np.uint64)
            for shard, lo, hi in blocks.ranges(asked_keys, blocks.even_shards(n_blocks)):
                codes[lo:hi] = blocks.unpack(given[0, shard])
            mass, left = decode((codes >> np.uint64(16)).astype(np.int64)), decode((codes & np.uint64(0xFFFF)).astype(np.int64))
            cut = np.cumsum([len(k) for k in keys])[:-1]
            logs = _log_probabilities(grams, np.split(mass[where], cut), np.split(left[where], cut), rest, uniform)
            total = np.bincount(np.repeat(np.arange(rows.num_rows), grams.lengths), logs[grams.of], rows.num_rows)
            return pa.table([*(rows.column(c) for c in place), pa.array(total), pa.array(grams.lengths)], names=schema.names)

        arrow = to_arrow_schema(schema)

        def one(key, table, answered):
            rows = blocks.open_rows(table)
            return arrow.empty_table() if rows is None else score(rows, blocks.given_of(answered)).cast(arrow)

        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)


def _key(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("l"), lang), F.lit("n"))


def _judged(docs: DataFrame, labels: DataFrame, keep: list[str], max_trusted: int, order: int, quantile: float, shrink: float, min_trusted: int) -> DataFrame:
    """The columns ``keep`` of ``docs`` as c0, c1, ..., with kn_symbols,
    kn_perplexity, kn_threshold and kn_keep.  Documents are scored once."""
    model = Model(docs, labels, max_trusted, order)
    scored = materialize(model.add(docs, keep))
    doc_id, lang = (f"c{keep.index(c)}" for c in ("doc_id", "lang"))
    scored = scored.withColumn("lkey", _key(F.col(lang)))
    trusted = scored.select(F.col(doc_id).alias("doc_id"), "lkey", "kn_logp", "kn_n").join(trusted_ids(labels).where("NOT fit"), "doc_id", "left_semi")
    mean = F.try_divide(F.sum("kn_logp"), F.sum("kn_n"))
    whole = trusted.agg(mean).first()[0] or 0.0
    drawn = lambda mean: -(F.col("kn_logp") + shrink * mean) / (F.col("kn_n") + shrink)  # noqa: E731  log10 perplexity
    # judged by the language's own mean and quantile, or by those of all
    means = trusted.groupBy("lkey").agg(F.count(F.lit(1)).alias("docs"), mean.alias("mean"))
    means = materialize(means.where(F.col("docs") >= min_trusted).select("lkey", F.coalesce("mean", F.lit(whole)).alias("mean")))
    limit = trusted.agg(F.percentile_approx(drawn(F.lit(whole)), quantile, 100_000)).first()[0]
    limits = trusted.join(broadcast_if_small(means, MANY_LANGUAGES), "lkey").groupBy("lkey", "mean").agg(F.percentile_approx(drawn(F.col("mean")), quantile, 100_000).alias("limit"))
    limits = materialize(limits)  # one row per language with trusted text
    row = scored.join(broadcast_if_small(limits, MANY_LANGUAGES), "lkey", "left")
    value = drawn(F.coalesce("mean", F.lit(whole)))
    bar = F.coalesce("limit", F.lit(float("inf") if limit is None else limit))
    return row.select(*[f"c{i}" for i in range(len(keep))], F.col("kn_n").alias("kn_symbols"), F.pow(F.lit(10.0), value).alias("kn_perplexity"),
                      F.pow(F.lit(10.0), bar).alias("kn_threshold"), (value <= bar + 1e-12).alias("kn_keep"))


#: production settings
SETTINGS = {"max_trusted": 20_000, "order": 4, "quantile": 0.99, "shrink": 200.0, "min_trusted": 50}


def judge(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, lang, kn_symbols, kn_perplexity, kn_threshold and kn_keep."""
    out = _judged(docs.select("doc_id", "lang", "text"), labels, ["doc_id", "lang"], **SETTINGS | settings)
    return out.withColumnsRenamed({"c0": "doc_id", "c1": "lang"})


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``docs`` (same columns) without the documents that are rejected."""
    out = _judged(docs, labels, docs.columns, **SETTINGS | settings).where("kn_keep")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
