"""Toxicity from the nearest labelled examples (exact TF-IDF cosine).

1. *Examples*: at most ``max_examples`` labelled documents of each class, the
   first by a hash of the id (a bounded, documented sample).
2. *Terms*: all terms of the examples that tell the classes apart: they explain
   at least a share ``effect`` of the labels' variance (chi-square of document
   counts by the number of examples), and that is not chance at the level
   ``error`` for all terms of the examples together (Bonferroni).  There is no
   cap on their number or length.  Their inverse document frequencies count all
   documents.
3. *Index*: an inverted index of the examples' unit TF-IDF vectors, in blocks
   of ``BLOCK`` examples; for every term and block the largest weight.  Examples
   are ordered by their heaviest term, so that a block holds like ones.
4. *Search*: for many documents at a time, the block bounds
   ``sum(q_t * max_t)`` are computed first; blocks are scored in falling order
   of the bound, until the k-th best cosine is not below the next bound.  The k
   nearest are exact (cosines to nine digits, ties to the smaller example id).
5. *Vote*: neighbours vote with their cosine, weighted by how much the sample
   thinned their class, smoothed by the share of toxic labels; isotonic
   regression over the examples' own leave-one-out votes turns votes into
   calibrated scores.  The nearest neighbours are returned as evidence.

Why not all terms: with every term of the documents in product and norm, the
neighbours are those of the same language and topic (measured in README).

The index is bounded by the sample (``2 * max_examples`` rows) and is broadcast;
every document is scored in whole.

Defined results: null, empty and term-less texts get the score of no
neighbours; without labels of both classes every score is the share of toxic
labels (0 if there are none); label rows without a document, null labels and
null ids are ignored; several labels of one document count as toxic if any is;
ties go to the smaller example id; repeated rows are scored each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_map, crc_mod, materialize, text_bytes
from parley.llm.decontaminate import item_words

BLOCK = 64
#: cosines are compared as whole numbers of this
DIGITS = 10**9


def sample_examples(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_examples: int) -> tuple[DataFrame, dict[int, int]]:
    """The examples (doc_id, toxic, text), and how many labelled documents of
    either class may be learnt from."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_mod(F.col("doc_id"), folds) != held_out)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = materialize(known.join(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi"))
    sizes = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    first = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit("example")), "doc_id").limit(max_examples)
    chosen = F.broadcast(first(0).unionByName(first(1)))  # at most 2 * max_examples ids
    examples = docs.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return materialize(examples), sizes


def critical_value(error: float) -> float:
    """The chi-square (one degree of freedom) exceeded with probability ``error``."""
    lo, hi = 0.0, 2000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2)) > error else (lo, mid)
    return hi


def choose_terms(examples: DataFrame, error: float, effect: float) -> list[bytes]:
    """The terms whose document counts differ between the classes by ``effect``
    or more, with a chance of ``error`` that any is chosen by accident."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, list[int]] = {}
        for toxic, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            for w in set(item_words(t)):
                seen.setdefault(w, [0, 0])[toxic] += 1
        counts = [[n[c] for n in seen.values()] for c in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=["w", "n0", "n1"])

    size = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    s0, s1 = float(size.get(0, 0)), float(size.get(1, 0))
    counts = arrow_map(examples.select("toxic", "text"), run, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = materialize(counts)
    n0, n1 = F.col("n0"), F.col("n1")
    below = (n0 + n1) * (s0 + s1 - n0 - n1) * s0 * s1
    chi = F.try_divide((s0 + s1) * F.pow(n1 * (s0 - n0) - n0 * (s1 - n1), 2), below)
    least = critical_value(error / max(counts.count(), 1))
    chosen = counts.where((below > 0) & (chi > least) & (chi >= effect * (s0 + s1)))
    return sorted(bytes(r["w"]) for r in chosen.select("w").collect())


def example_vectors(examples: DataFrame, terms: dict[bytes, int]) -> list[tuple]:
    """(doc_id, toxic, term ids, counts) of the examples, by doc_id: at most
    2 * max_examples rows."""
    kind = examples.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(_term_ids(t, terms), return_counts=True) for t in text_bytes(b.column(2))]
        lists = [pa.array([f[i].tolist() for f in found], pa.list_(pa.int64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "toxic", "ids", "tf"])

    rows = arrow_map(examples.select("doc_id", "toxic", "text"), run, f"doc_id {kind}, toxic int, ids array<long>, tf array<long>").orderBy("doc_id").collect()
    return [(r["doc_id"], r["toxic"], np.array(r["ids"], np.int64), np.array(r["tf"], np.int64)) for r in rows]


def document_frequencies(docs: DataFrame, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term, and how many there are."""
    m = len(terms)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        df = np.zeros(m, np.int64)
        for t in text_bytes(b.column(0)):
            df[np.unique(_term_ids(t, terms))] += 1
        at = np.flatnonzero(df)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["t", "n"])

    counts = arrow_map(docs.select("text"), run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(m, np.int64)
    for r in counts:
        df[r["t"]] = r["n"]
    return df, docs.count()


def _term_ids(text: bytes | None, terms: dict[bytes, int]) -> np.ndarray:
    words = item_words(text)
    ids = np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))
    return ids[ids >= 0]


def weigh(ids: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit TF-IDF vector of term counts: term ids and weights."""
    w = (1.0 + np.log(tf)) * idf[ids]
    norm = np.sqrt((w * w).sum())
    return (ids, w / norm) if norm > 0 else (ids[:0], w[:0])


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them), one after another."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class BlockMaxIndex:
    """Exact top-k cosine over examples for many queries, by block-max bounds."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], m: int):
        self.n, self.m = len(vectors), m
        self.blocks = max(1, -(-self.n // BLOCK))
        heaviest = [int(ids[np.argmax(w)]) if len(ids) else m for ids, w in vectors]
        self.order = np.array(sorted(range(self.n), key=lambda e: (heaviest[e], e)), np.int64)  # example at a position
        held = [vectors[e] for e in self.order]
        position = np.repeat(np.arange(self.n), [len(v[0]) for v in held])
        term = np.concatenate([v[0] for v in held]).astype(np.int64) if held else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in held]) if held else np.zeros(0)
        by = np.lexsort((position, term))
        position, term, weight = position[by], term[by], weight[by]
        self.place, self.weight = position % BLOCK, weight
        cell = term * self.blocks + position // BLOCK  # (term, block)
        self.start = np.searchsorted(cell, np.arange(m * self.blocks + 1))
        # the blocks that hold a term, and its largest weight there
        held_cells, first = np.unique(cell, return_index=True)
        self.block = held_cells % self.blocks
        self.top = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        self.term_start = np.searchsorted(held_cells // self.blocks, np.arange(m + 1))

    def nearest(self, ptr: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), one row of k per query, best first; -1 and 0 pad.

        Query q has the terms ``ids[ptr[q]:ptr[q + 1]]``; ``skip[q]`` is an example
        that is not one of its neighbours.
        """
        queries = len(ptr) - 1
        best = np.full((queries, k), -1, np.int64)
        if not self.n or not queries:
            return best, np.zeros((queries, k))
        n_blocks = self.term_start[ids + 1] - self.term_start[ids]
        at = _expand(self.term_start[ids], n_blocks)
        query = np.repeat(np.repeat(np.arange(queries), np.diff(ptr)), n_blocks)
        bound = np.bincount(query * self.blocks + self.block[at], self.top[at] * np.repeat(weights, n_blocks), queries * self.blocks)
        bound = bound.reshape(queries, self.blocks)
        falling = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, falling, 1)
        limit = np.where(bound > 0, np.ceil(bound * DIGITS) + 1, -1).astype(np.int64)
        # the example of a key: larger keys are nearer, then smaller examples
        rank = self.n - 1 - self.order
        done, step, left = 0, 4, np.flatnonzero(limit[:, 0] > 0)
        while len(left):
            wide = min(step, self.blocks - done)
            kth = best[left].min(axis=1) // self.n
            row, slot = np.nonzero((limit[left, done:done + wide] > 0) & (limit[left, done:done + wide] >= kth[:, None]))
            q, block = left[row], falling[left[row], done + slot]
            score = self._score(ptr, ids, weights, q, block)
            where = block[:, None] * BLOCK + np.arange(BLOCK)
            inside = np.minimum(where, self.n - 1)
            key = np.rint(score * DIGITS).astype(np.int64) * self.n + rank[inside]
            key[(score <= 0) | (where >= self.n)] = -1
            if skip is not None:
                key[self.order[inside] == skip[q][:, None]] = -1
            found = np.full((len(left), wide * BLOCK), -1, np.int64)
            found[row[:, None], slot[:, None] * BLOCK + np.arange(BLOCK)] = key
            best[left] = np.partition(np.concatenate((best[left], found), axis=1), -k, axis=1)[:, -k:]
            done, step = done + wide, min(step * 2, 32)
            if done >= self.blocks:
                break
            kth = best[left].min(axis=1) // self.n
            left = left[(limit[left, done] > 0) & (limit[left, done] >= kth)]
        best = -np.sort(-best, axis=1)
        cos = np.where(best >= 0, np.minimum(best // self.n / DIGITS, 1.0), 0.0)
        return np.where(best >= 0, self.n - 1 - best % self.n, -1), cos

    def _score(self, ptr, ids, weights, q, block) -> np.ndarray:
        """The cosines of each query of ``q`` with the examples of its block."""
        terms = ptr[q + 1] - ptr[q]
        pair, at = np.repeat(np.arange(len(q)), terms), _expand(ptr[q], terms)
        cell = ids[at] * self.blocks + block[pair]
        n = self.start[cell + 1] - self.start[cell]
        posting = _expand(self.start[cell], n)
        score = np.bincount(np.repeat(pair, n) * BLOCK + self.place[posting], self.weight[posting] * np.repeat(weights[at], n), len(q) * BLOCK)
        return score.reshape(len(q), BLOCK)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and non-decreasing values."""
    xs, back = np.unique(x, return_inverse=True)
    total = np.bincount(back, w)
    mean = np.bincount(back, w * y) / total
    stack: list[list[float]] = []  # first x, last x, weight, mean
    for a, t, v in zip(xs.tolist(), total.tolist(), mean.tolist()):
        stack.append([a, a, t, v])
        while len(stack) > 1 and stack[-2][3] >= stack[-1][3]:
            _, b, t2, v2 = stack.pop()
            p = stack[-1]
            p[1], p[3], p[2] = b, (p[2] * p[3] + t2 * v2) / (p[2] + t2), p[2] + t2
    return np.array([v for s in stack for v in s[:2]]), np.array([s[3] for s in stack for _ in (0, 1)])


class Scorer:
    """Votes of the nearest examples, as plain data that can be broadcast."""

    def __init__(self, examples, terms: list[bytes], idf: np.ndarray, n0: int, n1: int, k: int, smooth: float = 0.25):
        self.terms = {w: i for i, w in enumerate(terms)}
        self.idf, self.k, self.smooth = idf, k, smooth
        self.ids = [e[0] for e in examples]
        self.toxic = np.array([e[1] for e in examples], np.float64)
        self.prior = n1 / (n0 + n1) if n0 + n1 else 0.0
        held = [max(1, int((self.toxic == c).sum())) for c in (0, 1)]
        # a sampled example stands for so many labelled documents, 1 on average
        share = [n / h for n, h in zip((n0, n1), held)]
        mean = (n0 + n1) / max(1, len(self.ids))
        self.class_weight = np.where(self.toxic == 1, share[1] / mean, share[0] / mean) if len(self.ids) else np.zeros(0)
        vectors = [weigh(ids, tf, idf) for _, _, ids, tf in examples]
        self.index = BlockMaxIndex(vectors, len(terms))
        self.knots = None
        if self.ids and 0 < n1 and 0 < n0:
            votes = self._votes(*self._nearest(vectors, np.arange(len(vectors))))
            self.knots = isotonic(votes, self.toxic, self.class_weight)

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: np.ndarray | None = None, chunk: int = 256):
        found = []
        for a in range(0, len(vectors), chunk):
            part = vectors[a:a + chunk]
            ptr = np.concatenate(([0], np.cumsum([len(v[0]) for v in part])))
            ids, weights = (np.concatenate([v[i] for v in part]) for i in (0, 1))
            found.append(self.index.nearest(ptr, ids.astype(np.int64), weights, self.k, None if skip is None else skip[a:a + chunk]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _votes(self, best: np.ndarray, cos: np.ndarray) -> np.ndarray:
        w = np.where(best >= 0, cos * self.class_weight[best], 0.0)
        return ((w * self.toxic[best]).sum(axis=1) + self.smooth * self.prior) / (w.sum(axis=1) + self.smooth)

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple]]]:
        """Calibrated scores and the evidence (example id, cosine, label)."""
        if self.knots is None or not texts:
            return np.full(len(texts), self.prior), [[] for _ in texts]
        vectors = [weigh(*np.unique(_term_ids(t, self.terms), return_counts=True), self.idf) for t in texts]
        best, cos = self._nearest(vectors)
        scores = np.clip(np.interp(self._votes(best, cos), *self.knots), 0.0, 1.0)
        shown = [[(self.ids[b], c, int(self.toxic[b])) for b, c in zip(bs, cs) if b >= 0] for bs, cs in zip(best[:, :3].tolist(), cos[:, :3].tolist())]
        return scores, shown


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, k: int = 15, max_examples: int = 3000, error: float = 0.01, effect: float = 0.01) -> DataFrame:
    """doc_id, held_out, score, predicted, and evidence: the three nearest
    examples as ``id:cosine:label``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    examples, sizes = sample_examples(docs, labels, folds, held_out, max_examples)
    terms = choose_terms(examples, error, effect)
    place = {w: i for i, w in enumerate(terms)}
    df, n = document_frequencies(docs, place)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    model = spark.sparkContext.broadcast(Scorer(example_vectors(examples, place), terms, idf, sizes[0], sizes[1], k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, evidence = model.value.score(text_bytes(b.column(1)))
            shown = [", ".join(f"{i}:{c:.4f}:{t}" for i, c, t in e) for e in evidence]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(shown, pa.string())], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    out = docs.withColumn("held_out", crc_mod(F.col("doc_id"), folds) == held_out)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence string")
