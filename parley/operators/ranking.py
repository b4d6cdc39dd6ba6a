"""Row numbers in groups of any size.

``row_number()`` sorts a whole group in one task.  :func:`number_rows` range
partitions by group and order instead, so a group that holds a third of all
rows spans many tasks, numbers the rows inside each task, and adds the rows of
the group in earlier tasks.  The sorted rows are materialised by a checkpoint
in the shared folder, which fixes the task numbers for both uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.session import materialize


def number_rows(df: DataFrame, group: list[str], order: list[Column], name: str,
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in ``order`` within ``group``.

    ``order`` must be a total order of the group's rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + list(order)
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    s = materialize(s)
    summary = s.groupBy("_pid", *group).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per task and group: at most ``partitions`` rows per group
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    summary = summary.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first",
                             F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    match = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = s.join(summary, match)
    return out.withColumn(name, (F.col("_offset") + F.col("_mid") - F.col("_first")).cast("long")).select(*df.columns, name)
