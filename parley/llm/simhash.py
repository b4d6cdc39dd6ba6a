"""SimHash near-duplicates by BK-trees over sharded fingerprints.

1. *Fingerprints* (Arrow batches): ASCII-lower-cased words, ``shingle``-word
   shingles with repeats, XXH64 with seed 42; a bit is set if more than half
   of the hashes set it.
2. *Shards*: two fingerprints within ``radius`` bits agree on at least
   ``4 - radius`` of their four 16-bit quarters, so every distinct fingerprint
   goes to one shard per choice of that many quarters (exact for radius 2: six
   shards of 32 equal bits).  A shard is a BK-tree - children keyed by their
   Hamming distance to the parent - built and searched in the task that holds
   it, following only the edges within the radius.  One tree over all
   fingerprints broadcast to all tasks would grow with the corpus; the
   quarters bring together all that can match instead.
3. *Components*: a shard returns a spanning forest of its links, never all
   pairs; large-star / small-star rounds join the forests.

Copies share a fingerprint, so a group of any number of copies is one node.

Defined results: null and word-less texts have fingerprint zero and link like
any other; texts shorter than a shingle are one shingle; rows with a null
doc_id take part in links but never name a component while a non-null id is
there; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_map, materialize, text_bytes

LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, k: int) -> list[int]:
    """XXH64 (seed 42) of the k-word shingles of one text."""
    words = (text or b"").lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    h = xxhash.xxh64_intdigest
    return [h(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash of each run of ``hashes``; ``counts`` are the run lengths.

    Bits are summed in byte lanes of 64-bit words over pieces of at most 255
    hashes, then pieces are summed per run.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    at = np.repeat(starts - first * 255, pieces) + np.arange(pieces.sum()) * 255
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        bits = 2 * ones > counts[full][:, None]
        for byte in range(8):
            out[full] |= bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the fingerprint ``fp`` (the 64 bits as a signed long)."""
    src = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", fp long"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes: list[int] = []
        counts = np.zeros(b.num_rows, np.int64)
        parts = []
        for i, t in enumerate(text_bytes(b.column(len(keep)))):
            h = shingle_hashes(t, shingle)
            counts[i] = len(h)
            hashes += h
            if len(hashes) > 1 << 18:  # ints to numpy piece by piece
                parts.append(np.array(hashes, np.uint64))
                hashes = []
        parts.append(np.array(hashes, np.uint64))
        fp = majority(np.concatenate(parts), counts).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], names=[*keep, "fp"])

    return arrow_map(src, run, schema)


class BKTree:
    """Integers under Hamming distance; children keyed by the distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_find(self, x: int, radius: int) -> list[int]:
        """Positions of earlier values within ``radius`` of ``x``; adds ``x``."""
        found = []
        if self.values:
            todo = [0]
            while todo:
                node = todo.pop()
                d = (self.values[node] ^ x).bit_count()
                if d <= radius:
                    found.append(node)
                kids = self.children[node]
                if len(kids) <= 2 * radius + 1:
                    todo += [c for e, c in kids.items() if d - radius <= e <= d + radius]
                else:
                    todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
            node = 0
            while True:
                d = (self.values[node] ^ x).bit_count()
                if d not in self.children[node]:
                    self.children[node][d] = len(self.values)
                    break
                node = self.children[node][d]
        self.values.append(x)
        self.children.append({})
        return found


def shard_forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one shard (edges to the roots)."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.add_and_find(x, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(values[find(i)], values[i]) for i in range(len(values)) if find(i) != i]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that join all distinct ``fp`` linked within ``radius``."""
    if not 0 <= radius <= 3:
        raise ValueError("four quarters are exact for a radius of 0 to 3")
    keep = 4 - radius
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = []
    for n, choice in enumerate(combinations(range(4), keep)):
        value = F.lit(0).cast("long")
        for q in choice:
            value = F.shiftleft(value, 16).bitwiseOR(quarter[q])
        keys.append(F.struct(F.lit(n).alias("c"), value.alias("v")))
    routed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.c", "k.v", "fp")
    # only shards with more than one member are worth a tree
    routed = routed.repartition("c", "v").sortWithinPartitions("c", "v", "fp")

    def run(batches):
        held = None
        for b in batches:
            held, out = forests(b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0], last=False)
            if out is not None:
                yield out
        if held is not None:
            _, out = forests(held, last=True)
            if out is not None:
                yield out

    def forests(b: pa.RecordBatch, last: bool):
        """The forests of the whole shards in ``b``; what may go on is held."""
        if not b.num_rows:
            return None, None
        c, v, fp = (b.column(i).to_numpy() for i in range(3))
        cut = np.flatnonzero((c[1:] != c[:-1]) | (v[1:] != v[:-1])) + 1
        ends = np.append(cut, b.num_rows)
        begins = np.insert(cut, 0, 0)
        if not last:
            rest = b.slice(int(begins[-1]))
            begins, ends = begins[:-1], ends[:-1]
        else:
            rest = None
        edges: list[tuple[int, int]] = []
        for i in np.flatnonzero(ends - begins > 1):
            edges += shard_forest([int(x) for x in fp[begins[i]:ends[i]].view(np.uint64)], radius)
        if not edges:
            return rest, None
        e = np.array(edges, np.uint64).view(np.int64).reshape(-1, 2)
        return rest, pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return routed.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): large-star / small-star.

    Each round is two joins on the edges; the star forest they converge to has
    the smallest node of a component as its centre.  Every round is cut by a
    checkpoint; only two scalars per round reach the driver.
    """
    edges = materialize(edges.where("a != b").select("a", "b").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        edges = materialize(small.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _grouped(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(documents, fingerprints): doc_id, th (a hash of the text) and fp per
    document; component_id and first - the document that stays - per fp.

    Components are formed over distinct fingerprints; a large group of copies
    meets its row by a plain join, which Spark splits when it is skewed.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    fps = materialize(fingerprints(keyed, shingle, ("doc_id", "th")))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(order).alias("first")))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    return fps, named.select("fp", "root").join(groups, "root").drop("root")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps, groups = _grouped(docs, shingle, radius)
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id
    (null last; rows that share it: the smallest text hash)."""
    _, groups = _grouped(docs, shingle, radius)
    keep = groups.select(F.col("first.doc_id").alias("k"), F.col("first.th").alias("kh")).distinct()
    # one key for the join and for equal rows, so that texts move once
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    kept = row.join(keep.select(name("k").alias("i"), F.col("kh").alias("h")), ["i", "h"], "left_semi")
    return kept.dropDuplicates(["i", "h"]).select("row.*")
