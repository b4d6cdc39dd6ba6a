"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import materialize  # noqa: F401  (checkpoint in the shared folder)

#: a word of the contracts: a run of anything but space and \t \n \v \f \r.
#: ``bytes.split()`` cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column (no decoding to ``str``)."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(m))


def n_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def hash_words(words: list[bytes]) -> np.ndarray:
    """The XXH64 (seed 0) of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray | int, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """An order-sensitive 64-bit mix of two hash arrays."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(odd)) ^ b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(RecordBatch) -> RecordBatch | None``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (cheap to count: materialised or tiny) with a broadcast hint up
    to ``rows`` rows, as it is beyond them."""
    return F.broadcast(df) if df.count() <= rows else df


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and text bytes of the corpus (two scalars)."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def blocked(docs: DataFrame, n_blocks: int, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` dealt to ``n_blocks`` blocks by a hash of id and text, one
    exchange that later steps on the same blocks reuse."""
    block = F.pmod(F.xxhash64(*columns), F.lit(n_blocks)).cast("int")
    return docs.select(*columns).withColumn("block", block).repartition(n_blocks, "block")


def block_count(spark: SparkSession, n_bytes: int, block_mb: int = 24) -> int:
    """Blocks of about ``block_mb`` MB of text, at least the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (block_mb << 20)))
