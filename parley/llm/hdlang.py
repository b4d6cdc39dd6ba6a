"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded
by its code point.  An n-gram binds its letters by permuting (rolling) each
letter's vector by its place and multiplying them.  A text bundles - adds up -
the vectors of its n-grams; a language prototype bundles the texts of that
language.  The prediction is the prototype with the largest cosine, which is
also the score (0 to 1).

Texts are lower-cased; everything between letters counts as one blank, a
symbol with a vector of its own.  Counts of distinct n-grams are multiplied
with a cached table of n-gram vectors, so a long text costs little more than
a short one.

Prototypes come from a bounded sample of the learning documents (at most about
``max_train`` per language, by a hash of the id); partial prototypes are
added up by Spark and only one vector per language reaches the driver.

Defined results: null texts and texts without a letter are ``und`` with score
0; without learning documents all are ``und``; ties go to the smaller language
name; rows without a language are never learnt from; repeated rows count each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import broadcast_if_small, crc_mod, materialize

BLANK = 32
MANY_LANGUAGES = 10_000  # names beyond which their table is not broadcast


class Encoder:
    """Texts to bundled n-gram vectors of ``dims`` dimensions."""

    def __init__(self, dims: int = 1024, order: int = 3, seed: int = 11, full: int = 40_000):
        self.dims, self.order, self.seed, self.full = dims, order, seed, full
        self.symbol = np.full(0x110000, -1, np.int32)  # code point -> symbol
        self.symbol[BLANK] = 0
        self.letters = [self._random(BLANK)]
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[int, int] = {}
        self.table = np.zeros((1024, self.dims), np.int8)

    def _random(self, code_point: int) -> np.ndarray:
        return (np.random.default_rng((self.seed, code_point)).integers(0, 2, self.dims) * 2 - 1).astype(np.int8)

    def _learn_symbols(self, points: np.ndarray) -> None:
        for cp in np.unique(points).tolist():
            if self.symbol[cp] < 0:
                if chr(cp).isalpha():
                    self.symbol[cp] = len(self.letters)
                    self.letters.append(self._random(cp))
                else:
                    self.symbol[cp] = 0

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbol[points]
        if len(s) and s.min() < 0:
            self._learn_symbols(points[s < 0])
            s = self.symbol[points]
        s = s.astype(np.int64)
        return s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))] if len(s) else s

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes of a text and how often each occurs."""
        s = self.symbols(text)
        if not s.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s = np.pad(s, (int(s[0] != 0), int(s[-1] != 0)))  # blanks around
        s = np.concatenate((np.zeros(max(0, self.order - len(s)), np.int64), s))
        code = s[: len(s) - self.order + 1].astype(np.int64)
        for i in range(1, self.order):
            code = code << 21 | s[i:len(s) - self.order + 1 + i].astype(np.int64)
        return np.unique(code, return_counts=True)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Table rows of n-gram codes; new n-grams are bound and added."""
        if len(self.row_of) + len(codes) > self.full:
            self.forget()
        get = self.row_of.get
        rows = [get(c, -1) for c in codes.tolist()]
        if -1 in rows:
            for i, r in enumerate(rows):
                if r < 0:
                    rows[i] = r = len(self.row_of)
                    if r == len(self.table):
                        self.table = np.concatenate((self.table, np.zeros_like(self.table)))
                    code = int(codes[i])
                    self.row_of[code] = r
                    self.table[r] = self.bind(code)
        return np.array(rows, np.int64)

    def bind(self, code: int) -> np.ndarray:
        out = np.ones(self.dims, np.int8)
        for back in range(self.order):  # the last letter is not rolled
            out = out * np.roll(self.letters[code & 0x1FFFFF], back)
            code >>= 21
        return out

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The vector of a text, None if it has no letter."""
        codes, n = self.counts(text or "")
        if not len(codes):
            return None
        total = np.zeros(self.dims, np.float32)
        for at in range(0, len(codes), 4096):
            rows = self.rows(codes[at:at + 4096])  # may move the table
            total += n[at:at + 4096].astype(np.float32) @ self.table[rows].astype(np.float32)
        return total


def prototypes(train: DataFrame, dims: int, order: int, seed: int, max_train: int) -> list[tuple[str, np.ndarray]]:
    """(lang, unit vector) of the languages of ``train`` (text, lang, doc_id)."""
    sizes = train.groupBy("lang").count()
    share = materialize(sizes.select("lang", F.least(F.lit(1.0), F.lit(float(max_train)) / F.col("count")).alias("share")))
    chosen = train.join(broadcast_if_small(share, MANY_LANGUAGES), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = Encoder(dims, order, seed), {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = enc.bundle(text)
                if v is not None:
                    total[lang] = total.get(lang, 0.0) + v.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = chosen.select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    out = []
    for r in found:
        v = np.array([e["x"] for e in r["v"]])
        norm = np.linalg.norm(v)
        if norm:
            out.append((r["lang"], v / norm))
    return out


def predict_languages(docs: DataFrame, folds: int = 4, held_out: int = 2, dims: int = 1024, order: int = 3, seed: int = 11, max_train: int = 5000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and margin (to the second best)."""
    docs = docs.select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"))
    train = docs.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    profiles = prototypes(train, dims, order, seed, max_train)
    names = [n for n, _ in profiles]
    matrix = np.stack([v for _, v in profiles]).astype(np.float32) if profiles else np.zeros((0, dims), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(dims, order, seed)
        for b in batches:
            lang, score, margin = [], [], []
            for text in b.column(1).to_pylist():
                v = enc.bundle(text) if names else None
                norm = float(np.linalg.norm(v)) if v is not None else 0.0
                if not norm:
                    lang.append("und"), score.append(0.0), margin.append(0.0)
                    continue
                cos = (matrix @ v) / norm
                best = int(np.argmax(cos))
                second = float(np.partition(cos, -2)[-2]) if len(cos) > 1 else 0.0
                lang.append(names[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
                margin.append(float(cos[best]) - second)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "margin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin double")
