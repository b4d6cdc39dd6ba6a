"""From raw documents to a training mix, in five stages.

Every stage works on all that its predecessor kept and its decisions take
effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, kneser_ney, mixing, pii, simhash
from parley.llm.common import materialize, read


def pii_key(spark: SparkSession) -> str:
    """The pseudonym key, from ``spark.parley.pii.key`` (set it in production)."""
    return spark.conf.get("spark.parley.pii.key", "parley-test-key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects go."""
    return kneser_ney.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; documents that are little else go as a whole."""
    clean = decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark"), window=10, max_coverage=0.8)
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become format-preserving pseudonyms."""
    return pii.pseudonymise(docs, pii_key(spark))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with their number of copies (mix_copies)."""
    return mixing.apply_mix(docs, weights=(5, 2, 1), share=1.5, max_rate=2.0)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("mixing", mixing_sources),
]

#: SQL can express neither SimHash nor the language model; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
