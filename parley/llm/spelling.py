"""Spelling variants: words one error apart, from a bidirectional FM-index.

The vocabulary is counted over all texts.  A word of length L is cut after
L // 2 code points.  One inserted, deleted or replaced code point leaves one of
the halves as it is, so two searches find every near word: the first half
exactly from the left end and then one error across the second, or the second
half exactly from the right end and then one error across the first.  What the
second search finds and the first does too is left to the first.

The index has two directions, each over the delimited words ``$w1$w2$...$``:
their suffix ranks for reading leftwards and those of the mirrored words for
reading rightwards.  A search carries the interval of ranks of the suffixes that
start with what it has read; a step by a code point is two counts in the
transform.  All searches of a shard step together as arrays.

Sharding: a word is sent to the shards of the halves that its near words of the
same length, one less and one more can have, and it asks in the shards of its own
two halves.  So no shard needs the whole vocabulary and nothing is broadcast but
the list of very frequent halves, whose words are dealt to several parts that all
of the half's searches visit.

Defined cases: a null text has no words; a null ``doc_id`` is written as empty in
the hash; rows are counted as they come, repeated ones too; very long runs are
words like others (equal intervals are searched once); ties go to the smallest
word in code-point order; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import broadcast_if_small, text_bytes
from parley.session import materialize

#: a shard's symbols: delimiter, a-z, U+00C0 to U+00FF
DELIMITER, SYMBOLS = 0, 91
NEAR = "word string, n_near long, form string, form_n long"


# -- the vocabulary -----------------------------------------------------------------

def damaged(run: str, h: int) -> str:
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, min_chars: int, min_count: int, damage: int, most: int = 400_000) -> DataFrame:
    """(word, n) of the words that are long and frequent enough.

    Every ``damage``-th run by crc32("<doc_id>:<run>") loses a code point.  A
    task counts up to ``most`` words before it passes them on.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")  # finds maximal runs: greedy, and shorter ones fail

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                if not text:
                    continue
                found = pattern.findall(text.lower().decode())  # bytes: lowers A-Z only
                counts.update(found)
                base = zlib.crc32(f"{'' if i is None else i}:".encode())
                for r in set(found):
                    h = zlib.crc32(r.encode(), base)
                    if h % damage == 0:
                        k = found.count(r)
                        counts[r] -= k
                        if len(r) > min_chars:
                            counts[damaged(r, h)] += k
                if len(counts) > most:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    words = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- the index ----------------------------------------------------------------------

def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by doubling the length they are sorted by."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (max(n, SYMBOLS) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words one after another, and where each word starts."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    symbols = np.where(points < 0xC0, points - 96, points - 0xC0 + 27)
    return symbols, np.concatenate(([0], np.cumsum([len(w) for w in words])))


class Direction:
    """One direction of the index: sorted, distinct words, read from their ends."""

    def __init__(self, words: list[str]):
        symbols, starts = encode(words)
        text = np.insert(symbols, starts, DELIMITER)  # $w1$w2$...$
        order = suffix_order(text)
        self.size = len(text)
        self.before = text[order - 1]  # the symbol before each suffix
        self.ranks = np.sort(self.before * self.size + np.arange(self.size))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with ``symbol`` before those of each interval."""
        base = symbol * self.size
        return np.searchsorted(self.ranks, base + lo), np.searchsorted(self.ranks, base + hi)

    def extend(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, lo, hi) of every code point before each interval."""
        width = hi - lo
        wide = np.flatnonzero(width > SYMBOLS)
        narrow = np.flatnonzero(width <= SYMBOLS)
        k = width[narrow]
        rows = np.repeat(lo[narrow] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        seen = np.repeat(narrow, k) * SYMBOLS + self.before[rows]
        tried = (wide[:, None] * SYMBOLS + np.arange(1, SYMBOLS)).reshape(-1)
        both = np.concatenate((np.unique(seen), tried))
        at, symbol = both // SYMBOLS, both % SYMBOLS
        at, symbol = at[symbol != DELIMITER], symbol[symbol != DELIMITER]
        a, b = self.step(symbol, lo[at], hi[at])
        found = a < b
        return at[found], symbol[found], a[found], b[found]


def one_error(index: Direction, asked: np.ndarray, starts: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of all words one error away from each query.

    ``asked[starts[q]:starts[q + 1]]`` are a query's symbols in reading order; the
    first ``exact[q]`` must match.  Words are numbered in the index's order.
    """
    lengths = np.diff(starts)
    none = np.zeros(0, np.int64)
    q = np.arange(len(lengths))
    lo, hi = index.step(np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.size))
    eq, elo, ehi = none, none, none  # searches that have made their error
    out_q, out_w = [none], [none]
    for at in range(int(lengths.max(initial=0)) + 1):
        free = exact[q] <= at
        fq, flo, fhi = q[free], lo[free], hi[free]
        i, symbol, a, b = index.extend(flo, fhi)
        # an inserted code point before the query's next
        eq, elo, ehi = distinct(np.concatenate((eq, fq[i])), np.concatenate((elo, a)), np.concatenate((ehi, b)))
        # searches at their end: the delimiter must follow
        ended = lengths[eq] == at
        w, w_end = index.step(np.zeros(int(ended.sum()), np.int64), elo[ended], ehi[ended])
        found = w < w_end
        out_q.append(eq[ended][found])
        out_w.append(w[found] - 1)  # rank 0 is the last delimiter
        eq, elo, ehi = eq[~ended], elo[~ended], ehi[~ended]
        elo, ehi = index.step(asked[starts[eq] + at], elo, ehi)
        # a replaced and a deleted code point
        more = lengths[fq] > at
        other = more[i] & (symbol != asked[np.minimum(starts[fq[i]] + at, len(asked) - 1)])
        eq = np.concatenate((eq, fq[i][other], fq[more]))
        elo, ehi = np.concatenate((elo, a[other], flo[more])), np.concatenate((ehi, b[other], fhi[more]))
        alive = elo < ehi
        eq, elo, ehi = eq[alive], elo[alive], ehi[alive]
        more = lengths[q] > at
        q, lo, hi = q[more], lo[more], hi[more]
        lo, hi = index.step(asked[starts[q] + at], lo, hi)
        alive = lo < hi
        q, lo, hi = q[alive], lo[alive], hi[alive]
    pairs = np.unique(np.concatenate(out_q) * index.size + np.concatenate(out_w))
    return pairs // index.size, pairs % index.size


def distinct(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal searches once."""
    if not len(q):
        return q, lo, hi
    order = np.lexsort((hi, lo, q))
    q, lo, hi = q[order], lo[order], hi[order]
    fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    return q[fresh], lo[fresh], hi[fresh]


def near_words(asking: list[str], words: list[str], n: np.ndarray, mirrored: bool, block: int = 4096) -> tuple[list, list, list, list]:
    """(word, n_near, form, form_n) of the asking words that have near ones among
    the sorted ``words`` with counts ``n``."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    if not words:
        return out
    read = [w[::-1] for w in words] if mirrored else words
    order = sorted(range(len(words)), key=read.__getitem__)
    index = Direction([read[i] for i in order])
    order = np.array(order)
    for first in range(0, len(asking), block):
        mine = asking[first:first + block]
        symbols, starts = encode(mine if mirrored else [w[::-1] for w in mine])  # as they are read
        half = np.array([len(w) // 2 for w in mine])
        q, w = one_error(index, symbols, starts, half if mirrored else np.diff(starts) - half)
        w = order[w]
        if not mirrored:  # those with the same first half are the other direction's
            keep = np.fromiter((words[x][:len(mine[i]) // 2] != mine[i][:len(mine[i]) // 2] for i, x in zip(q.tolist(), w.tolist())), bool, len(q))
            q, w = q[keep], w[keep]
        best = np.lexsort((w, -n[w], q))
        q, w = q[best], w[best]
        heads = np.flatnonzero(np.diff(q, prepend=-1))
        counts = np.diff(heads, append=len(q))
        for i, x, c in zip(q[heads].tolist(), w[heads].tolist(), counts.tolist()):
            for column, value in zip(out, (mine[i], c, words[x], int(n[x]))):
                column.append(value)
    return out


# -- sharding -----------------------------------------------------------------------

def halves(words: DataFrame) -> DataFrame:
    """(kind, piece, word, n, asks): the halves a word is found by.

    Kind 0 is read from the left (first halves), kind 1 from the right.  Near
    words differ in length by one at most, so there are two of each kind, and one
    of them is the word's own half, where it asks.
    """
    size = F.char_length("word")
    own = F.floor(size / 2).cast("int")
    even = size % 2 == 0
    pieces = F.array(
        F.struct(F.lit(0).alias("kind"), F.substring("word", F.lit(1), own).alias("piece"), F.lit(True).alias("asks")),
        F.struct(F.lit(0).alias("kind"), F.substring("word", F.lit(1), F.when(even, own - 1).otherwise(own + 1)).alias("piece"), F.lit(False).alias("asks")),
        F.struct(F.lit(1).alias("kind"), F.substring("word", own + 1, size).alias("piece"), F.lit(True).alias("asks")),
        F.struct(F.lit(1).alias("kind"), F.substring("word", F.when(even, own).otherwise(own + 2), size).alias("piece"), F.lit(False).alias("asks")))
    return words.select("word", "n", F.inline(pieces))


def sharded(rows: DataFrame, n_words: int, shard_words: int) -> DataFrame:
    """``rows`` with their ``shard``.  A half of more than ``shard_words`` words
    has parts of its own: a word is in one of them and asks in all."""
    spark = rows.sparkSession
    key = ["kind", "piece"]
    parts = materialize(rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / shard_words).cast("int").alias("parts")).where("parts > 1"))
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * n_words // shard_words))
    rows = rows.join(broadcast_if_small(parts, 100_000), key, "left")
    common = rows.where(F.col("parts").isNull()).withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(n_shards))).withColumn("found", F.lit(True))
    hot = rows.where(F.col("parts").isNotNull()).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    hot = hot.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))))
    hot = hot.withColumn("shard", -1 - F.shiftrightunsigned(F.xxhash64(*key, "part"), 2)).withColumn("found", F.col("part") == F.col("mine"))
    columns = ["kind", "shard", "word", "n", "asks", "found"]
    return common.select(*columns).unionByName(hot.select(*columns))


def search_shard(key, table):
    """The near words that the asking words of a group (kind, shard) have there."""
    held: dict[str, int] = {}  # a word can come by two of its halves
    asking = set()
    for w, n, asks, found in zip(*(table.column(c).to_pylist() for c in ("word", "n", "asks", "found"))):
        if found:
            held[w] = n
        if asks:
            asking.add(w)
    words = sorted(held)
    out = near_words(sorted(asking), words, np.array([held[w] for w in words], np.int64), key[0].as_py() == 0)
    return pa.table([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "form", "form_n"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by pointer doubling.

    A form is at least twice as frequent as its word, so chains are shorter than
    the logarithm of the largest count and the rounds than its logarithm.
    """
    table = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = table.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(table.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        table = moved.select("word", "root")


def spelling_groups(docs: DataFrame, min_chars: int = 5, min_count: int = 3, damage: int = 97, ratio: int = 2,
                    shard_words: int = 50_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs`` (doc_id, text).

    ``form`` is the most frequent near word where it is at least ``ratio`` times
    as frequent, ``root`` the last word that forms lead to.
    """
    words = materialize(count_words(docs, min_chars, min_count, damage))
    rows = sharded(halves(words), words.count(), shard_words)
    near = rows.groupBy("kind", "shard").applyInArrow(search_shard, NEAR)
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    table = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).cast("long").alias("form_n"))
    table = materialize(table)
    led = roots(table.where(F.col("form").isNotNull()))
    return table.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
