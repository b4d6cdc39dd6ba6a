"""LM scoring with a sharded Elias-Fano n-gram trie.

*Model.*  Trigrams over word hashes (A-Z lower-cased), interpolated with smoothed
bigrams and unigrams:

    p(w | u v) = (c(uvw) - D)+ / c(uv) + D * successors(uv) / c(uv) * p(w | v)
    p(w | v)   = (c(vw) + M * p(w)) / (c(v) + M)
    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))

All counts are of the whole training text.  The result depends on the corpus
only, not on shards, blocks or partitions.

*Frequent words.*  A shard holds all trigrams (u, v, w) of a middle word v.  A v
that occurs ``hot_tokens`` times or more is split by classes of u, so that a word
that is a third of all tokens is spread over all shards, with all counts of a
context (u, v) in one of them.  The bigram counts of such a v are not in one
shard then: blocks ask for them by a message kind of their own, split by (v, w).

*Trie.*  A shard keeps its middle words (v, or v and a class of u) in three levels:

    roots        sorted context keys
    successors   words after a root, and the preceding words u of a root
    trigrams     per (u v), its successors as *positions among the root's
                 successors* - small numbers, relative to the context

Each level is one monotone sequence (node * universe + key), stored as an
Elias-Fano code: packed low bits and a unary high part, with the offset of
every 4096th element.  Pointers into the next level are monotone as well and
coded the same way.  Probability masses are stored as 16-bit codes of their
logarithm, rounded so that no distribution gains mass.  The levels are written
to one file in the task's temporary folder and memory-mapped; queries come in
key order and read only the pieces they fall in (successor search).

*Flow.*  Blocks send their distinct unigrams, trigrams and bigrams of frequent words with their counts in
training documents (:mod:`parley.llm.blocks`); shards build the trie from the
training counts and answer each block's trigrams with the two masses of
``p = A + B * p(w)``; blocks add up their documents.  What is gathered grows
with the corpus, nothing is pruned, and every shard and block stays small.

Word hashes: 64 bits for unigrams (the base score is exact up to collisions of
64-bit hashes, and bigrams of frequent words as well); in the trie 39 bits name
the root, 24 the preceding word within its root and 24 the successor, so few rare
words share an entry (a root of 100,000 preceding words: 0.6 % of them).

Defined results: null text is the empty text, one end token; no training
documents give the uniform base; ids without text are scored; repeated rows
count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import blocks
from parley.llm.common import arrow_map, block_count, corpus_size, crc_mod, hash_words, mix, n_words, text_bytes

END = xxhash.xxh64_intdigest(b" end", 0)  # no word holds a space
START = xxhash.xxh64_intdigest(b" start", 0)
UNIGRAMS, TRIGRAMS, BIGRAMS = 0, 1, 2
ROOT_BITS, PREV_BITS, NEXT_BITS = 40, 24, 24
#: bigram counts weigh against this many tokens of the unigram distribution
PRIOR_TOKENS = 50.0
PIECE = 4096
STEP = 4096.0  # codes per power of ten
NONE = 0xFFFF


# -- codes of probabilities ---------------------------------------------------

def encode(mass: np.ndarray) -> np.ndarray:
    """16-bit codes of -log10, rounded towards less mass; 0xFFFF: none."""
    with np.errstate(divide="ignore"):
        c = np.ceil(-np.log10(mass) * STEP - 1e-9)
    return np.where(mass > 0, np.clip(c, 0, NONE - 1), NONE).astype(np.uint16)


def decode(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == NONE, 0.0, 10.0 ** (-(codes.astype(np.float64)) / STEP))


# -- Elias-Fano ----------------------------------------------------------------

def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(0, np.uint8)
    out = []
    for at in range(0, len(values), 1 << 16):  # 2**16 values fill whole bytes
        v = values[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(v, axis=1, bitorder="little")[:, :width], bitorder="little"))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _unpack_bits(data: np.ndarray, width: int, begin: int, end: int) -> np.ndarray:
    """Values [begin, end); ``begin`` is a multiple of 8."""
    if not width:
        return np.zeros(end - begin, np.uint64)
    bits = np.unpackbits(data[begin * width // 8:-(-end * width // 8)], count=(end - begin) * width, bitorder="little").reshape(-1, width)
    full = np.zeros((end - begin, 64), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


class EliasFano:
    """A non-decreasing sequence of integers below 2**63."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        unary[high] = 1
        self.low = _pack_bits(values & np.uint64((1 << self.low_bits) - 1), self.low_bits)
        self.high = np.packbits(unary, bitorder="little")
        self.at = high[::PIECE]  # unary position of every PIECE-th element
        self.lead = values[::PIECE]

    def arrays(self) -> list[str]:
        return ["low", "high", "at", "lead"]

    def piece(self, p: int) -> np.ndarray:
        """Elements [p * PIECE, (p + 1) * PIECE)."""
        begin, end = p * PIECE, min(self.n, (p + 1) * PIECE)
        first = int(self.at[p])
        last = int(self.at[p + 1]) if p + 1 < len(self.at) else len(self.high) * 8
        byte = first // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte:-(-last // 8)], bitorder="little")) + byte * 8
        ones = ones[ones >= first][: end - begin]
        return ((ones - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.low_bits)) | _unpack_bits(self.low, self.low_bits, begin, end)

    def get(self, index: np.ndarray) -> np.ndarray:
        """The elements at non-decreasing positions."""
        out = np.zeros(len(index), np.uint64)
        for p, lo, hi in _pieces(index // PIECE):
            out[lo:hi] = self.piece(p)[index[lo:hi] - p * PIECE]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of non-decreasing ``keys`` in a sequence without repeats;
        -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        for p, lo, hi in _pieces(np.searchsorted(self.lead, keys, side="right") - 1):
            if p >= 0:
                values = self.piece(p)
                i = np.searchsorted(values, keys[lo:hi])
                hit = values[np.minimum(i, len(values) - 1)] == keys[lo:hi]
                out[lo:hi] = np.where(hit, i + p * PIECE, -1)
        return out


def _pieces(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(piece, begin, end) of the runs of equal values."""
    if not len(of):
        return []
    at = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
    return [(int(of[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:])]


# -- the trie of one shard -----------------------------------------------------

class Trie:
    """Built from the distinct trigrams (root, prev, next, count) of a shard in
    the order of (root, prev, next)."""

    LEVELS = ("roots", "succ", "prev", "tri", "succ_ptr")
    CODES = ("succ_mass", "root_back", "tri_mass", "prev_back")

    def __init__(self, root, prev, nxt, count, prior: float = PRIOR_TOKENS, d3: float = 0.75):
        u64 = np.uint64
        roots, r = np.unique(root, return_inverse=True)
        self.roots = EliasFano(roots)
        # (root, next): successors of the roots
        pair, back, c2 = _sums(r.astype(u64) << u64(NEXT_BITS) | nxt, count)
        of_root = (pair >> u64(NEXT_BITS)).astype(np.int64)
        total = np.bincount(of_root, c2, len(roots))
        kinds = np.bincount(of_root, minlength=len(roots))
        self.succ = EliasFano(pair)
        pointer = np.concatenate(([0], np.cumsum(kinds)))
        self.succ_ptr = EliasFano(pointer)
        # the bigrams of a root that is split (odd keys) are not all here
        whole = (roots & u64(1)) == 0
        self.succ_mass = encode(np.where(whole[of_root], c2 / (total[of_root] + prior), 0.0))
        self.root_back = encode(np.where(whole, prior / (total + prior), 1.0))
        # (root, prev): the bigram contexts, in trigram order
        node, ctx, c1 = _sums(r.astype(u64) << u64(PREV_BITS) | prev, count)
        n3 = np.bincount(ctx, minlength=len(node))
        self.prev = EliasFano(node)
        self.prev_back = encode(np.minimum(1.0, d3 * n3 / np.maximum(c1, 1)))
        # trigrams: position of next among its root's successors, after the
        # room of all earlier contexts
        room = kinds[(node >> u64(PREV_BITS)).astype(np.int64)]
        base = np.cumsum(room) - room
        relative = back - pointer[r]
        self.tri = EliasFano((base[ctx] + relative).astype(u64))
        self.tri_mass = encode(np.maximum(count - d3, 0) / c1[ctx])
        self.tri_base = EliasFano(base.astype(u64))

    def map_to(self, folder: str) -> "Trie":
        """Writes the arrays to one file and maps it."""
        held = [(getattr(self, level), name) for level in (*self.LEVELS, "tri_base") for name in getattr(self, level).arrays()] + [(self, name) for name in self.CODES]
        handle, path = tempfile.mkstemp(dir=folder, suffix=".trie")
        places = []
        with os.fdopen(handle, "wb") as f:
            for owner, name in held:
                f.write(b"\0" * (-f.tell() % 8))
                a = np.ascontiguousarray(getattr(owner, name))
                places.append((owner, name, f.tell(), a.dtype, len(a)))
                f.write(a.tobytes())
        data = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        os.unlink(path)  # the map keeps it until the task drops the trie
        for owner, name, at, kind, n in places:
            setattr(owner, name, data[at:at + n * kind.itemsize].view(kind))
        return self

    def masses(self, root, prev, nxt) -> tuple[np.ndarray, np.ndarray]:
        """(A, B) of ``p = A + B * p(next)`` for trigrams in key order; of
        ``p = A + B * p(next | v)`` where v is split."""
        u64 = np.uint64
        a, b = np.zeros(len(root)), np.ones(len(root))
        r = self.roots.find(root)
        k = np.flatnonzero(r >= 0)
        if not len(k):
            return a, b
        r = r[k]
        back2 = decode(self.root_back[r])
        # context-relative successor search: the place among the root's
        # successors, then that place under the bigram context
        key = r.astype(u64) << u64(NEXT_BITS) | nxt[k]
        order = np.argsort(key, kind="stable")
        s = np.empty(len(k), np.int64)
        s[order] = self.succ.find(key[order])
        mass2 = np.where(s >= 0, decode(self.succ_mass[np.maximum(s, 0)]), 0.0)
        c = self.prev.find(r.astype(u64) << u64(PREV_BITS) | prev[k])
        mass3, back3 = np.zeros(len(k)), np.ones(len(k))
        known = np.flatnonzero(c >= 0)
        back3[known] = decode(self.prev_back[c[known]])
        both = known[s[known] >= 0]
        place = self.tri_base.get(c[both]) + (s[both] - self.succ_ptr.get(r[both]).astype(np.int64)).astype(u64)
        t = self.tri.find(place)
        mass3[both] = np.where(t >= 0, decode(self.tri_mass[np.maximum(t, 0)]), 0.0)
        a[k] = mass3 + back3 * mass2
        b[k] = back3 * back2
        return a, b


def _sums(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, back, np.bincount(back, count, len(distinct))


# -- blocks ---------------------------------------------------------------------

class Tokens:
    """The tokens of a block and their distinct unigrams, trigrams, and bigrams
    of the frequent words ``hot`` (sorted hashes)."""

    def __init__(self, rows: pa.Table, classes: int, hot: np.ndarray):
        parts, ends = [], []
        for t in blocks.texts_of(rows):
            words = t.lower().split()  # bytes: A-Z only
            h = np.empty(len(words) + 3, np.uint64)
            h[:2] = START
            h[2:-1] = hash_words(words)
            h[-1] = END
            parts.append(h)
            ends.append(len(h))
        flat = np.concatenate(parts)
        ends = np.cumsum(ends)
        token = np.ones(len(flat), bool)  # all but the two starts
        begins = ends - np.diff(ends, prepend=0)
        token[begins] = token[begins + 1] = False
        at = np.flatnonzero(token)
        self.counts = np.diff(ends, prepend=0) - 2
        self.word = flat[at]
        u, v = flat[at - 2], flat[at - 1]
        del flat, token, at, parts
        self.train = np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool), self.counts)
        split = np.zeros(len(v), bool)
        if len(hot):
            split = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
        self.split_at = np.flatnonzero(split).astype(np.int32)
        self.pair, self.pair_of = np.unique(mix(v[split], self.word[split], 0xC2B2AE3D27D4EB4F), return_inverse=True)
        self.pair_of = self.pair_of.astype(np.int32)
        self.pair_count = np.bincount(self.pair_of, self.train[self.split_at], len(self.pair)).astype(np.uint64)
        # a class of u goes into the root of a split word, other bits of u tell it within
        root = mix(v, np.where(split, mix(u, 1) % np.uint64(classes) + np.uint64(1), np.uint64(0))) >> np.uint64(64 - ROOT_BITS)
        root = root & ~np.uint64(1) | split.astype(np.uint64)
        rest = (mix(u, 2) >> np.uint64(64 - PREV_BITS)) << np.uint64(NEXT_BITS) | (self.word >> np.uint64(64 - NEXT_BITS))
        del u, v, split
        order = blocks.order_pairs(root, rest, PREV_BITS + NEXT_BITS)
        root, rest = root[order], rest[order]
        new = np.ones(len(order), bool)
        new[1:] = (root[1:] != root[:-1]) | (rest[1:] != rest[:-1])
        group = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.root, self.rest = root[new], rest[new]
        del root, rest
        self.tri_count = np.bincount(group, self.train[order], len(self.root)).astype(np.uint64)
        self.tri_of = np.empty(len(order), np.int32)
        self.tri_of[order] = group
        del order, group, new
        self.uni, self.uni_of = np.unique(self.word, return_inverse=True)
        del self.word
        self.uni_of = self.uni_of.astype(np.int32)
        self.uni_count = np.bincount(self.uni_of, self.train, len(self.uni)).astype(np.uint64)


def _body(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at:at + 8], "little")
        out.append(body[at + 8:at + 8 + n])
        at += 8 + n
    return out


def _root_shards(n: int):
    return lambda root: (root * np.uint64(n)) >> np.uint64(ROOT_BITS) if n < 1 << 23 else root >> np.uint64(ROOT_BITS - 23)


def _send(rows: pa.Table, n_shards: int, classes: int, hot: np.ndarray):
    t = Tokens(rows, classes, hot)
    for shard, lo, hi in blocks.ranges(t.uni, blocks.even_shards(n_shards)):
        yield UNIGRAMS, shard, _body(blocks.pack_sorted(t.uni[lo:hi]), blocks.pack(t.uni_count[lo:hi]))
    for shard, lo, hi in blocks.ranges(t.pair, blocks.even_shards(n_shards)):
        yield BIGRAMS, shard, _body(blocks.pack_sorted(t.pair[lo:hi]), blocks.pack(t.pair_count[lo:hi]))
    for shard, lo, hi in blocks.ranges(t.root, _root_shards(n_shards)):
        yield TRIGRAMS, shard, _body(blocks.pack_sorted(t.root[lo:hi]), blocks.pack(t.rest[lo:hi]), blocks.pack(t.tri_count[lo:hi]))


def _count_keys(bodies: list[bytes]) -> list[bytes]:
    """The training counts of all blocks' keys (unigrams, split bigrams)."""
    sent = [_parts(b) for b in bodies]
    keys = [blocks.unpack_sorted(p[0]) for p in sent]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate([blocks.unpack(p[1]) for p in sent])).astype(np.uint64)
    return [blocks.pack(x) for x in np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])]


def _query_trie(bodies: list[bytes]) -> list[bytes]:
    """Builds the shard's trie and answers the trigrams of all blocks.

    Equal trigrams of several blocks are one query, and all queries go through
    the trie together in key order, so each of its pieces is read once.
    """
    field = lambda i, f: [f(_parts(b)[i]) for b in bodies]
    roots = field(0, blocks.unpack_sorted)
    sizes, root = [len(r) for r in roots], np.concatenate(roots)
    del roots
    rest, count = (np.concatenate(field(i, blocks.unpack)) for i in (1, 2))
    order = blocks.order_pairs(root, rest, PREV_BITS + NEXT_BITS)
    root, rest = root[order], rest[order]
    new = np.ones(len(root), bool)
    new[1:] = (root[1:] != root[:-1]) | (rest[1:] != rest[:-1])
    group = np.cumsum(new) - 1
    root, rest, total = root[new], rest[new], np.bincount(group, count[order])
    nxt, prev = rest & np.uint64((1 << NEXT_BITS) - 1), rest >> np.uint64(NEXT_BITS)
    learnt = total > 0
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(root[learnt], prev[learnt], nxt[learnt], total[learnt]).map_to(folder)
        codes = [encode(m) for m in trie.masses(root, prev, nxt)]
    of = np.empty(len(order), np.int64)
    of[order] = group
    ends = np.cumsum(sizes)[:-1]
    return [_body(blocks.pack(a), blocks.pack(b)) for a, b in zip(*(np.split(c[of], ends) for c in codes))]


def _counts(keys: np.ndarray, kind: int, n_shards: int, given: dict) -> np.ndarray:
    count = np.zeros(len(keys))
    for shard, lo, hi in blocks.ranges(keys, blocks.even_shards(n_shards)):
        count[lo:hi] = blocks.unpack(given[kind, shard])
    return count


def _score(rows: pa.Table, n_shards: int, classes: int, hot: np.ndarray, total: int, vocabulary: int, given: dict) -> pa.Table:
    t = Tokens(rows, classes, hot)
    count = _counts(t.uni, UNIGRAMS, n_shards, given)
    a, b = np.zeros(len(t.root)), np.ones(len(t.root))
    for shard, lo, hi in blocks.ranges(t.root, _root_shards(n_shards)):
        codes = [decode(blocks.unpack(p)) for p in _parts(given[TRIGRAMS, shard])]
        a[lo:hi], b[lo:hi] = codes
    c = count[t.uni_of]
    base = (c + 0.5) / (total + 0.5 * (vocabulary + 1))
    lower = base.copy()  # what a trigram falls back to: the unigram, or the bigram of a split word
    at = t.split_at
    lower[at] = (_counts(t.pair, BIGRAMS, n_shards, given)[t.pair_of] + PRIOR_TOKENS * base[at]) / (c[at - 1] + PRIOR_TOKENS)
    p = a[t.tri_of] + b[t.tri_of] * lower
    doc = np.repeat(np.arange(len(t.counts)), t.counts)
    add = lambda x: np.bincount(doc, x, len(t.counts))
    columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(t.counts), pa.array(add(c > 0).astype(np.int64)), pa.array(add(np.log10(base))), pa.array(add(np.log10(np.maximum(p, 1e-300))))]
    return pa.table(dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"), columns)))


def _corpus_counts(train: DataFrame, hot_tokens: int) -> tuple[int, int, np.ndarray]:
    """N and V, all and distinct tokens of the training documents, and the hashes
    of the words that are split: at most a million, whatever the corpus is."""
    total = train.agg(F.coalesce(F.sum(n_words(F.col("text")) + 1), F.lit(0))).first()[0]
    least = max(hot_tokens, total // 10**6)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words: Counter = Counter()
        texts = text_bytes(b.column(0))
        for t in texts:
            words.update((t or b"").lower().split())
        h = np.append(hash_words(list(words)), np.uint64(END))
        n = np.append(np.fromiter(words.values(), np.int64, len(words)), len(texts))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = arrow_map(train.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    r = counts.agg(F.count(F.lit(1)).alias("v"), F.collect_list(F.when(F.col("n") >= least, F.col("h"))).alias("hot")).first()
    hot = np.array(r["hot"], np.int64).view(np.uint64)
    return total, r["v"], np.sort(hot[hot != np.uint64(END)])


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1, block_mb: int = 8, hot_tokens: int = 500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id) mod ``folds`` is ``held_out`` are scored but
    not learnt from.
    """
    docs = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"))
    total, vocabulary, hot = _corpus_counts(docs.where("NOT held_out"), hot_tokens)
    n_blocks = block_count(docs.sparkSession, corpus_size(docs)[1], block_mb)
    classes = total // hot_tokens + 1
    dealt = blocks.deal(docs, n_blocks)
    asked = blocks.ask(dealt, lambda rows, _: _send(rows, n_blocks, classes, hot))
    answers = blocks.answer(asked, lambda kind, shard, bodies: _query_trie(bodies) if kind == TRIGRAMS else _count_keys(bodies))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = blocks.settle(dealt, answers, lambda rows, given: _score(rows, n_blocks, classes, hot, total, vocabulary, given), schema)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
