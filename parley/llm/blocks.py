"""Block exchange: how operators ask the whole corpus about their own documents.

Documents are dealt once to blocks of a few MB.  A block sends its sorted,
packed keys to the shards that own them; a shard sees the keys of all blocks
and answers each block in the order of its keys; the answers meet the block's
documents again in a cogroup.  Keys are pre-aggregated per block, so a key
that fills a third of the corpus is one entry per block, and both blocks and
shards stay the same size as the corpus grows (there are more of them).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import text_bytes


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes (empty planes are left out)."""
    values = np.ascontiguousarray(values, np.uint64)
    planes = values.view(np.uint8).reshape(-1, 8)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    body = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, :width].T).tobytes())
    return len(values).to_bytes(8, "little") + bytes([width]) + body


def unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9:], max_output_size=n * width), np.uint8).reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Non-decreasing integers as packed gaps."""
    values = np.asarray(values, np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def deal(docs: DataFrame, n_blocks: int, by: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """(block, rows): the rows of each block as compressed Arrow, one exchange.

    The block is a hash of ``by``, id and text.  The result is used several times
    in one plan, where Spark reuses the exchange.
    """
    cols = docs.columns
    keyed = docs.withColumn("_block", F.pmod(F.xxhash64(*by), F.lit(n_blocks)).cast("int"))

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            block = b.column(len(cols)).to_numpy()
            rows = pa.RecordBatch.from_arrays(b.columns[: len(cols)], names=cols)
            order = np.argsort(block, kind="stable")
            ids, starts = np.unique(block[order], return_index=True)
            blobs = []
            for lo, hi in zip(starts, [*starts[1:], len(order)]):
                sink = pa.BufferOutputStream()
                part = rows.take(pa.array(order[lo:hi]))
                with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                    w.write_batch(part)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "rows"])

    return keyed.mapInArrow(run, "block int, rows binary").repartition(n_blocks, "block")


def open_rows(table: pa.Table) -> pa.Table | None:
    """The documents of a block (None: it has none)."""
    parts = [pa.ipc.open_stream(x).read_all() for x in table.column("rows").to_pylist()]
    return pa.concat_tables(parts) if parts else None


def texts_of(rows: pa.Table) -> list[bytes]:
    """The texts as bytes; null has no words, as the empty text."""
    return [t or b"" for t in text_bytes(rows.column("text"))]


def ids_of(rows: pa.Table) -> np.ndarray:
    """doc_id as int64 for comparing; null comes before every id."""
    return rows.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


def ranges(sorted_keys: np.ndarray, shard_of: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of sorted keys whose shards do not decrease."""
    if not len(sorted_keys):
        return []
    shard = shard_of(sorted_keys)
    at = np.concatenate(([0], np.flatnonzero(np.diff(shard.astype(np.int64))) + 1, [len(shard)]))
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:])]


def even_shards(n: int, bits: int = 64) -> Callable[[np.ndarray], np.ndarray]:
    """Keys of ``bits`` bits to ``n`` equal ranges, in order."""
    return lambda keys: ((keys >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)


def order_pairs(high: np.ndarray, low: np.ndarray, low_bits: int) -> np.ndarray:
    """The order of (high, low) pairs: one sort of the leading 64 bits, then
    only runs that are equal in those are sorted by ``low`` (``low_bits`` bits)."""
    spare = low_bits - (64 - int(high.max()).bit_length()) if len(high) else 0
    spare = max(0, spare)
    lead = (high << np.uint64(low_bits - spare)) | (low >> np.uint64(spare))
    order = np.argsort(lead)
    lead = lead[order]
    same = np.flatnonzero(lead[1:] == lead[:-1])
    if len(same):
        tied = np.zeros(len(order), bool)
        tied[same] = tied[same + 1] = True
        at = np.flatnonzero(tied)
        members = order[at]
        order[at] = members[np.lexsort((low[members], lead[at]))]
    return order


def message_table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def ask(dealt: DataFrame, fn, answers: DataFrame | None = None) -> DataFrame:
    """Messages (kind, shard, block, body) of every block; ``fn`` gets the
    block's id, rows and its answers (kind, shard) -> body."""
    names, kinds = ["kind", "shard", "block", "body"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    schema = "kind int, shard long, block int, body binary"

    def one(block, docs, given):
        rows = open_rows(docs)
        out = [] if rows is None else [(k, s, block, body) for k, s, body in fn(rows, given)]
        return message_table(out, names, kinds)

    if answers is None:
        return dealt.groupBy("block").applyInArrow(lambda key, t: one(key[0].as_py(), t, {}), schema)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda key, t, a: one(key[0].as_py(), t, given_of(a)), schema)


def given_of(answers: pa.Table) -> dict:
    return {(k, s): body for k, s, body in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "body")))}


def answer(messages: DataFrame, fn) -> DataFrame:
    """Each (kind, shard) over the messages of all blocks; ``fn(kind, shard,
    bodies)`` gives one body per message, in order."""
    schema = "kind int, shard long, block int, body binary"

    def one(key, t):
        out = fn(key[0].as_py(), key[1].as_py(), t.column("body").to_pylist())
        return pa.table({"kind": t.column("kind"), "shard": t.column("shard"), "block": t.column("block"), "body": pa.array(out, pa.binary())})

    return messages.groupBy("kind", "shard").applyInArrow(one, schema)


def settle(dealt: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """The result rows of every block from its rows and its answers."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def one(key, t, a):
        rows = open_rows(t)
        return arrow.empty_table() if rows is None else fn(rows, given_of(a)).cast(arrow)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)
