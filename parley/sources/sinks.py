"""Table writers.

Every writer writes whole DataFrames (never rows through the driver) into a
folder of its batch, ``<path>/batch_id=<id>``, and replaces that folder when
the batch is written again: a retried job or stream leaves one copy.  Readers
see one table with ``batch_id`` as partition column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import left
from parley.sources.schemas import with_defaults


def write_batch(df: DataFrame, path: str, batch_id: int | str, partition_by: list[str] | None = None) -> None:
    """Idempotent append: the batch's folder is replaced on a retry.

    A folder's rows go to one task first, so that a batch has as many files as
    folders, not folders times tasks; Spark cuts a folder that is too large for
    one task and puts small ones together (``rebalance``, AQE).
    """
    if partition_by:
        w = df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    else:
        w = df.write.mode("overwrite")
    w.parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def log_events(events: DataFrame, path: str, batch_id: int | str) -> None:
    """S3: analytics events with defaults, partitioned by event date."""
    e = with_defaults(events, "analytics_events")
    write_batch(e.withColumn("event_date", F.to_date("created_at")), path, batch_id, ["event_date"])


def log_violations(violations: DataFrame, path: str, batch_id: int | str) -> None:
    """Violations, stored query cut to 500 characters."""
    v = violations.withColumn("original_query", left(F.col("original_query"), 500))
    v = with_defaults(v, "guardrail_violations")
    write_batch(v.withColumn("event_date", F.to_date("created_at")), path, batch_id, ["event_date"])


def store_messages(messages: DataFrame, path: str, batch_id: int | str) -> None:
    """Stored conversation turns (user turns and replies)."""
    write_batch(with_defaults(messages, "messages"), path, batch_id)


def store_escalations(escalations: DataFrame, path: str, batch_id: int | str) -> None:
    """Escalation rows with defaults."""
    write_batch(with_defaults(escalations, "escalations"), path, batch_id)


def load_if_empty(df: DataFrame, path: str) -> None:
    """Write the rows only when nothing is stored at ``path`` yet."""
    df.write.mode("ignore").parquet(path)


def json_documents(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
