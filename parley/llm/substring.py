"""Substring dedup with a count-min prefilter.

A window is ``span`` consecutive words of one document.  Words covered by a
window whose words also start earlier in the corpus are removed.

1. *Sketch*: every block hashes its windows twice and sends the cells of a
   two-row count-min sketch.  The sketch has as many cells per row as the
   corpus has text bytes (rounded up to a power of two, so at most every
   second cell can be taken), is cut into shards of cells, and each shard adds
   up the partial sketches of all blocks.  Counters stop at two: more is not
   asked.
2. *Estimate*: a sum never falls below the true count, so a window with a cell
   below two in either row is unique.  Only windows estimated repeated go on;
   none that repeats is lost.
3. *Exact pass*: those windows are grouped by a 128-bit hash of their words
   (words are named by 64 bits, which both halves of it share).
   A block sends each distinct window with its first (doc_id, start); the
   shard answers whether that is the first in the corpus.  Every other
   occurrence is repeated, and its words go.

Windows are judged on the input, not on what is left.  Defined results: null
text has no words; texts shorter than a window lose nothing; a null doc_id
comes before all others; rows that share a doc_id start at the same place and
so do not remove each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm import blocks
from parley.llm.common import block_count, corpus_size, hash_words, mix

SHARD_BITS = 24  # cells of a sketch shard (one byte each while it is summed)
SKETCH, EXACT = 0, 2  # message kinds: SKETCH + row of the sketch, EXACT
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def window_hashes(words: np.ndarray, span: int, odd: int) -> np.ndarray:
    """A hash of every run of ``span`` neighbours, by doubling."""
    if len(words) < span:
        return np.zeros(0, np.uint64)
    power, width, out, done = words, 1, None, 0
    left = span
    while left:
        if left & 1:
            if out is None:
                out, done = power, width
            else:
                tail = power[done:]
                out, done = mix(out[: len(tail)], tail, odd), done + width
        left >>= 1
        if left:
            power, width = mix(power[:-width], power[width:], odd), 2 * width
    return out


class Windows:
    """The windows of a block: hashes a and b, document and start of each."""

    def __init__(self, rows: pa.Table, span: int):
        parts = [hash_words(t.split()) for t in blocks.texts_of(rows)]
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        per_doc = np.maximum(self.counts - span + 1, 0)
        self.doc = np.repeat(np.arange(len(parts)), per_doc)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        self.at = at = self.begins[self.doc] + self.start
        self.a, self.b = (window_hashes(words, span, odd)[at] for odd in ODD)
        self.id = blocks.ids_of(rows)[self.doc]

    def cells(self, row: int, bits: int) -> np.ndarray:
        return (self.b if row else self.a) >> np.uint64(64 - bits)


def _cell_shards(cells: np.ndarray) -> np.ndarray:
    return cells >> np.uint64(SHARD_BITS)


def _sketch(rows: pa.Table, span: int, bits: int):
    """The block's partial sketch: its cells in order, each at most twice."""
    w = Windows(rows, span)
    for row in (0, 1):
        cells = np.sort(w.cells(row, bits))
        if len(cells) > 2:
            cells = cells[np.concatenate(([True, True], cells[2:] != cells[:-2]))]
        for shard, lo, hi in blocks.ranges(cells, _cell_shards):
            yield SKETCH + row, shard, blocks.pack_sorted(cells[lo:hi] - np.uint64(shard << SHARD_BITS))


def _merge_sketch(bodies: list[bytes]) -> list[bytes]:
    """Sums the partial sketches; per block, which of its cells reach two."""
    count = np.zeros(1 << SHARD_BITS, np.uint8)
    distinct = []
    for body in bodies:
        cells = blocks.unpack_sorted(body).astype(np.int64)
        new = np.diff(cells, prepend=-1) != 0
        twice = cells[~new]
        cells = cells[new]
        count[cells] = np.minimum(count[cells] + 1, 2)
        count[twice] = 2
        distinct.append(cells)
    return [np.packbits(count[c] > 1).tobytes() for c in distinct]


def _repeated(w: Windows, bits: int, given: dict) -> np.ndarray:
    """Positions of the windows estimated repeated in both rows."""
    hot = np.ones(len(w.a), bool)
    for row in (0, 1):
        cells, back = np.unique(w.cells(row, bits), return_inverse=True)
        flags = np.zeros(len(cells), bool)
        for shard, lo, hi in blocks.ranges(cells, _cell_shards):
            flags[lo:hi] = np.unpackbits(np.frombuffer(given[SKETCH + row, shard], np.uint8), count=hi - lo)
        hot &= flags[back]
    return np.flatnonzero(hot)


def _firsts(w: Windows, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hot`` in the order of (a, b, id, start), its group numbers, and the
    place of each group's first occurrence in that order."""
    order = hot[np.lexsort((w.start[hot], w.id[hot], w.b[hot], w.a[hot]))]
    new = np.ones(len(order), bool)
    new[1:] = (w.a[order[1:]] != w.a[order[:-1]]) | (w.b[order[1:]] != w.b[order[:-1]])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _candidates(rows: pa.Table, span: int, bits: int, n_shards: int, given: dict):
    w = Windows(rows, span)
    order, _, first = _firsts(w, _repeated(w, bits, given))
    key = order[first]
    sign = np.uint64(1 << 63)  # ids as unsigned, in the same order
    for shard, lo, hi in blocks.ranges(w.a[key], blocks.even_shards(n_shards)):
        k = key[lo:hi]
        parts = [blocks.pack_sorted(w.a[k]), blocks.pack(w.b[k]), blocks.pack(w.id[k].view(np.uint64) ^ sign), blocks.pack(w.start[k])]
        yield EXACT, shard, b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at:at + 8], "little")
        out.append(body[at + 8:at + 8 + n])
        at += 8 + n
    return out


def _first_of_all(bodies: list[bytes]) -> list[bytes]:
    """Per block, which of its windows are the first of the corpus."""
    parts = [_split(x) for x in bodies]
    a = [blocks.unpack_sorted(p[0]) for p in parts]
    sizes = [len(x) for x in a]
    a = np.concatenate(a)
    b, ident, start = (np.concatenate([blocks.unpack(p[i]) for p in parts]) for i in (1, 2, 3))
    order = np.lexsort((start, ident, b, a))
    new = np.ones(len(order), bool)
    x, y = order[1:], order[:-1]
    new[1:] = (a[x] != a[y]) | (b[x] != b[y])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # first of the group of each
    first = np.zeros(len(order), bool)
    first[order] = (ident[order] == ident[lead]) & (start[order] == start[lead])
    return [np.packbits(x).tobytes() for x in np.split(first, np.cumsum(sizes)[:-1])]


def _cut(rows: pa.Table, span: int, bits: int, n_shards: int, given: dict) -> pa.Table:
    w = Windows(rows, span)
    order, group, first = _firsts(w, _repeated(w, bits, given))
    cover = np.zeros(int(w.counts.sum()) + 1, np.int64)
    if len(order):
        key = order[first]
        lead = np.zeros(len(key), bool)
        for shard, lo, hi in blocks.ranges(w.a[key], blocks.even_shards(n_shards)):
            lead[lo:hi] = np.unpackbits(np.frombuffer(given[EXACT, shard], np.uint8), count=hi - lo)
        mine = key[group]
        stays = lead[group] & (w.id[order] == w.id[mine]) & (w.start[order] == w.start[mine])
        gone = w.at[order[~stays]]
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + span, -1)
    removed = np.cumsum(cover)[:-1] > 0
    kept, n_removed = [], []
    for t, lo, n in zip(blocks.texts_of(rows), w.begins, w.counts):
        cut, words = removed[lo:lo + n], t.split()
        n_removed.append(int(cut.sum()))
        kept.append(b" ".join([x for x, c in zip(words, cut) if not c] if n_removed[-1] else words))
    return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(w.counts), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(kept, pa.binary()).cast(pa.string())})


def dedup_substrings(docs: DataFrame, span: int = 20, block_mb: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed and text: the kept words joined by a space."""
    docs = docs.select("doc_id", "text")
    n_bytes = corpus_size(docs)[1]
    bits = max(SHARD_BITS, int(n_bytes).bit_length())
    n_blocks = block_count(docs.sparkSession, n_bytes, block_mb)
    dealt = blocks.deal(docs, n_blocks)
    sketch = blocks.answer(blocks.ask(dealt, lambda rows, _: _sketch(rows, span, bits)), lambda kind, shard, bodies: _merge_sketch(bodies))
    asked = blocks.ask(dealt, lambda rows, given: _candidates(rows, span, bits, n_blocks, given), sketch)
    exact = blocks.answer(asked, lambda kind, shard, bodies: _first_of_all(bodies))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.settle(dealt, sketch.unionByName(exact), lambda rows, given: _cut(rows, span, bits, n_blocks, given), f"doc_id {kind}, n_words long, n_removed long, text string")
