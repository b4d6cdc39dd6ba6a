"""Joins with a table of unique keys whose frequent keys are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str, total: int, hot_keys: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` (one row per key), without ``weight``.

    ``weight`` is the number of a key's ``rows``, ``total`` the number of all.
    At most ``hot_keys`` keys can have more than ``total / hot_keys`` rows; these
    are broadcast, the others are joined by a shuffle, where no key is larger
    than that.
    """
    hot = F.col(weight) > total // hot_keys
    frequent = F.broadcast(unique.where(hot).drop(weight))
    rest = unique.where(~hot).drop(weight)
    return (rows.join(frequent, keys)
            .unionByName(rows.join(frequent.select(*keys), keys, "left_anti").join(rest, keys)))
