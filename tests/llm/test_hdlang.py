import zlib

import numpy as np

from parley.llm.hdlang import Encoder, predict_languages
from tests.conftest import SF01


def brute_bundle(enc, text):
    """Every n-gram bound on its own, letter by letter."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    kept = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    s = " " * (kept[0] != " ") + "".join(kept) + " " * (kept[-1] != " ")
    total = np.zeros(enc.dims)
    for i in range(len(s) - 2):
        a, b, c = (np.random.default_rng((enc.seed, ord(x))).integers(0, 2, enc.dims) * 2 - 1 for x in s[i:i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_bundle_against_brute_force():
    enc = Encoder(dims=256)
    for text in ("Hello, World!", "é", "  a b  c ", "Straße 12 ümläut", "日本語 text " * 50):
        assert np.array_equal(enc.bundle(text), brute_bundle(enc, text))
    assert enc.bundle("12 !") is None and enc.bundle(None) is None and enc.bundle("") is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = predict_languages(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_edges(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(8)] + [(20 + i, "der hund und die katze", "de") for i in range(8)]
    rows += [(50, None, "en"), (51, "12 345 !!", "de"), (52, "", None), (None, "the dog", None), (54, "und die " * 20000, None), (55, "字", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r.lang_pred for r in predict_languages(df).collect()}
    assert got[50] == got[51] == got[52] == "und" and got[None] == "en" and got[54] == "de" and got[55] in ("en", "de")
    assert {r.lang_pred for r in predict_languages(df.where("lang IS NULL")).collect()} == {"und"}
    assert predict_languages(df.limit(0)).count() == 0


def test_predictions_against_brute_force(spark):
    """Prototypes, cosine and margin from bundles made letter by letter."""
    docs = [(r.doc_id, (r.text or "")[:300], r.lang) for r in spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 120").select("doc_id", "text", "lang").collect()]
    enc = Encoder(dims=128)
    bundles = {i: brute_bundle(enc, t) if any(c.isalpha() for c in t) else None for i, t, _ in docs}
    sums = {}
    for i, _, lang in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and bundles[i] is not None:
            sums[lang] = sums.get(lang, 0) + bundles[i]
    unit = {lang: v / np.linalg.norm(v) for lang, v in sorted(sums.items())}
    got = predict_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), dims=128).collect()
    assert len(got) == len(docs) and len(unit) > 2
    for r in got:
        v = bundles[r.doc_id]
        if v is None or not np.linalg.norm(v):
            assert r.lang_pred == "und"
            continue
        cos = sorted(((float(u @ v) / np.linalg.norm(v), lang) for lang, u in unit.items()), reverse=True)
        assert abs(r.score - max(cos[0][0], 0)) < 1e-4 and abs(r.margin - (cos[0][0] - cos[1][0])) < 1e-4
        assert r.lang_pred == cos[0][1] or r.margin < 1e-4
