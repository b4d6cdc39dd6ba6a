"""Benchmark decontamination with a generalised suffix automaton.

The test items are normalised (ASCII lower case; words are runs of digits,
letters and non-ASCII bytes), their words numbered, and one suffix automaton
is built over all items.  Document words stream through it and the longest
match ending at each word is tracked; where it reaches the window length, or a
whole item shorter than a window ends there, those words are hit.

Most words of a document never come near an item, so each batch is first cut
to the runs of words whose neighbouring pairs all occur in items (one table
look-up per word); only runs as long as the shortest window go through the
automaton.  A run that is left out cannot hold a window, so nothing is lost.

The items are broadcast in parts of at most ``part_words`` words, one
automaton per part, each run over all documents in turn: memory per task is
bounded by a part however large the benchmark is.  Items are gathered part by
part, never all documents.

Defined results: null and word-less texts have no words and no hits; null and
word-less items have no window; repeated items and items that share an id
count once per id; items with a null id cause hits but are not listed; an
empty benchmark hits nothing; other columns are ignored by the search and kept
by :func:`remove_contamination`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import text_bytes

#: bytes of a word keep their value (A-Z in lower case), all others part words
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PAIR_BITS = 24


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            last = self._extend(last, c)

    def _clone(self, p: int, q: int, c: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        new = len(self.next) - 1
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # already there: shared with an earlier item
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        cur, p = len(self.next) - 1, last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def state_of(self, seq: list[int]) -> int:
        s = 0
        for c in seq:
            s = self.next[s][c]
        return s


class Matcher:
    """The windows of one part of the items, ready to search documents."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.vocab = window, {}
        self.sam = SuffixAutomaton()
        self.of_window: dict[tuple, set] = {}  # full window -> item ids
        self.whole: dict[int, list[tuple[int, tuple]]] = {}  # state -> whole short items that end in it
        self.least = window
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        seqs = []
        for ident, text in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in item_words(text)]
            if seq:
                seqs.append((ident, seq))
                self.sam.add(seq)
                self.least = min(self.least, len(seq))
                a = np.array(seq, np.int64)
                self.pairs[self._pair(a[:-1], a[1:])] = True
                for i in range(max(1, len(seq) - window + 1)):
                    self.of_window.setdefault(tuple(seq[i:i + window]), set()).add(ident)
        n = len(self.sam.next)
        for w in {tuple(s) for _, s in seqs if len(s) < window}:
            self.whole.setdefault(self.sam.state_of(list(w)), []).append((len(w), w))
        # nearest state on the link path (itself included) that ends a short item
        self.short = [-1] * n
        for s in sorted(range(n), key=self.sam.length.__getitem__):
            self.short[s] = s if s in self.whole else self.short[self.sam.link[s]] if self.sam.link[s] >= 0 else -1

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77) & ((1 << PAIR_BITS) - 1)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs long enough for a window whose words and pairs occur in items."""
        known = ids >= 0
        if not known.any():
            return []
        joined = np.zeros(len(ids) + 1, bool)  # word i-1 and word i can be neighbours
        both = np.flatnonzero(known[1:] & known[:-1])
        joined[both + 1] = self.pairs[self._pair(ids[both], ids[both + 1])]
        begins = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        long = ends - begins >= self.least
        return list(zip(begins[long].tolist(), ends[long].tolist()))

    def search(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [begin, end) of one document and the ids of the items."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        sam, window = self.sam, self.window
        for begin, end in self.runs(ids):
            seq = ids[begin:end].tolist()
            state = matched = 0
            for p, c in enumerate(seq):
                while state and c not in sam.next[state]:
                    state = sam.link[state]
                    matched = sam.length[state]
                if c in sam.next[state]:
                    state = sam.next[state][c]
                    matched += 1
                else:
                    matched = 0
                if matched >= window:
                    spans.append((begin + p + 1 - window, begin + p + 1))
                    found |= self.of_window[tuple(seq[p + 1 - window:p + 1])]
                s = self.short[state]
                while s >= 0:  # whole short items that end here
                    for n, w in self.whole[s]:
                        if n <= matched:
                            spans.append((begin + p + 1 - n, begin + p + 1))
                            found |= self.of_window[w]
                    s = self.short[sam.link[s]] if sam.link[s] >= 0 else -1
        return spans, found


def item_parts(items: DataFrame, part_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in parts of at most ``part_words`` words (an item that is
    longer is a part of its own), cut while the items are streamed."""
    part, room = [], part_words
    for ident, text in items.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL").distinct().toLocalIterator():
        raw = text.encode()
        n = len(item_words(raw))
        if part and n > room:
            yield part
            part, room = [], part_words
        part.append((ident, raw))
        room -= n
    if part:
        yield part


class Parts:
    """Matchers of the broadcast parts; one matcher is held at a time when
    there are several."""

    def __init__(self, broadcasts, window: int):
        self.broadcasts, self.window, self.held = broadcasts, window, {}

    def __getstate__(self):
        return self.__dict__ | {"held": {}}

    def __iter__(self) -> Iterator[Matcher]:
        for i, b in enumerate(self.broadcasts):
            if i not in self.held:
                self.held = {i: Matcher(b.value, self.window)}
            yield self.held[i]


def _matchers(spark: SparkSession, items: DataFrame, window: int, part_words: int) -> Parts:
    return Parts([spark.sparkContext.broadcast(p) for p in item_parts(items, part_words)], window)


def _find(texts: list[bytes | None], parts: Parts) -> list[tuple[int, list, set]]:
    """Per text: its number of words, hit spans and found ids."""
    words = [item_words(t) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = [x for w in words for x in w]
    out: list[tuple[int, list, set]] = [(len(w), [], set()) for w in words]
    for m in parts:
        ids = m.ids(flat)
        # documents are searched one by one, but only those with a long enough run
        bounded = np.insert(ids, ends, -1)  # a gap after each document
        at = ends + np.arange(1, len(ends) + 1)
        hot = {int(np.searchsorted(at, b, side="right")) for b, _ in m.runs(bounded)}
        for d in sorted(hot):
            lo = int(ends[d]) - len(words[d])
            spans, found = m.search(ids[lo:int(ends[d])])
            out[d][1].extend(spans)
            out[d][2].update(found)
    return out


def _hit(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    hit = np.zeros(n, bool)
    for b, e in spans:
        hit[b:e] = True
    return hit


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, part_words: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted strings),
    items_sha256, longest (words of the longest hit run), contaminated."""
    parts = _matchers(docs.sparkSession, items, window, part_words)
    src = docs.select("doc_id", "text")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, item_ids array<string>, items_sha256 string, longest long, contaminated boolean"

    def run(batches):
        for b in batches:
            rows = []
            for n, spans, found in _find(text_bytes(b.column(1)), parts):
                hit = _hit(n, spans) if spans else None
                n_hit = int(hit.sum()) if spans else 0
                ids = sorted(x for x in found if x is not None)
                longest = int(np.diff(np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])))))[::2].max()) if spans else 0
                rows.append((n, n_hit, len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), longest, n_hit > 0))
            cols = [list(c) for c in zip(*rows)] or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_words", "n_hit", "n_items", "item_ids", "items_sha256", "longest", "contaminated"])

    return src.mapInArrow(run, schema)


def _without(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words and what stands between two of them."""
    shown = text.translate(_TABLE)
    out, at, pos = [], 0, 0
    bounds = []
    for w in shown.split():  # byte bounds of the words
        pos = shown.index(w, pos)
        bounds.append((pos, pos + len(w)))
        pos += len(w)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    for b, e in zip(edges[::2], edges[1::2]):
        out.append(text[at:bounds[b][0]])
        at = bounds[e - 1][1]
    out.append(text[at:])
    return b"".join(out)


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.8, part_words: int = 500_000) -> DataFrame:
    """``docs`` (same columns) without the hit spans; a document more than
    ``max_coverage`` of whose words are hit is removed as a whole."""
    parts = _matchers(docs.sparkSession, items, window, part_words)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column(at))
            keep, new = np.ones(len(texts), bool), list(texts)
            for i, (n, spans, _) in enumerate(_find(texts, parts)):
                if spans:
                    hit = _hit(n, spans)
                    keep[i] = hit.sum() <= max_coverage * n
                    new[i] = _without(texts[i], hit)
            column = pa.array(new, pa.binary()).cast(pa.string()).cast(b.schema.field(at).type)
            out = b.set_column(at, b.schema.field(at), column)
            yield out.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
