"""Request latency from start/stop marks.

A stop is paired with the start of the same request id by an equi-join
(both sides hash-partitioned on the id, ids are unique so there is no hot
key); a stop without a start gets NULL, a start without a stop produces no
row (an open timer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elapsed_ms(start, stop):
    """Whole milliseconds between two timestamps."""
    return F.unix_millis(stop.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def request_latency(marks: DataFrame) -> DataFrame:
    starts = marks.where(F.col("mark") == "start").select("request_id", F.col("at").alias("started_at"))
    stops = marks.where(F.col("mark") == "stop").select("request_id", F.col("at").alias("stopped_at"))
    j = stops.join(starts, "request_id", "left")
    return j.select("request_id", "started_at", "stopped_at",
                    elapsed_ms(F.col("started_at"), F.col("stopped_at")).alias("elapsed_ms"))
