"""The registered queries of the operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import decontaminate, hdlang, imatch, kneser_ney, line_runs, mixing, pii, prefix_trie, simhash, spelling, sql, substring, toxicity, trie_lm
from parley.llm.common import read

Builder = Callable[[SparkSession, str], DataFrame]


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(read(spark, sf_dir, "documents"))


def op2_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(read(spark, sf_dir, "documents"), span=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = trie_lm.score_documents(read(spark, sf_dir, "documents"), folds=5, held_out=1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), folds=5, held_out=0)


def op7_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_rate=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdlang.predict_languages(read(spark, sf_dir, "documents"), folds=4, held_out=2)


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, corpus_pipeline.pii_key(spark), report=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, n_turns = prefix_trie.encode(read(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.regraft(own, every=100, most=6), n_turns)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read(spark, sf_dir, "documents"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_runs.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Builder] = {f.__name__: f for f in (
    op1_imatch, op2_count_min_substrings, op3_elias_fano_trie, op4_simhash_bk_trees, op5_kneser_ney,
    op6_nearest_examples, op7_entropy_balancing, op8_suffix_automaton, op9_hyperdimensional_language, op10_feistel_pseudonyms,
    op11_prefix_trie, op12_spelling_variants, op13_line_runs,
)} | {"pipeline": corpus_pipeline.run}


def queries() -> dict[str, Builder]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
