"""Stored tables that change: upserts, updates and checked appends.

*Keyed tables* (S10, S11) are Parquet folders partitioned by ``bucket``, a hash
of the key.  A change set is combined with the stored rows of the buckets it
touches, and only those buckets are written again, by Spark's dynamic partition
overwrite.  Changes are combined by newest version or by ``greatest``, so a
change set that is replayed, or comes after a newer one, changes nothing.

*Checked appends* (S8, S12) enforce what the other side only reports: a batch is
compared with the keys that earlier batches stored and with the referenced
tables, rows that violate a constraint go with their reason to a table of
rejects, and both tables have one folder per batch id, which a replay replaces.

Everything is joins and partial aggregates; only bucket numbers (at most
``buckets`` of them) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import materialize
from parley.sources.sinks import write_batch


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# -- keyed tables -------------------------------------------------------------------

@dataclass(frozen=True)
class KeyedTable:
    """A table with a unique key, partitioned by a hash of it.

    ``buckets`` must not change once the table is written; about 128 MB a bucket
    keep a change set of a few keys cheap.
    """

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def create(self, rows: DataFrame) -> None:
        """The table's first rows; their keys must be unique."""
        self._write(rows.withColumn("bucket", self.bucket()), "overwrite")

    def touched(self, changes: DataFrame) -> list[int]:
        return sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())

    def stored(self, buckets: list[int]) -> DataFrame:
        """The rows of ``buckets``; other partitions are not listed or read."""
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(buckets))

    def upsert(self, changes: DataFrame, version: str) -> int:
        """Insert or replace rows: per key the one with the newest ``version``
        stays (equal versions: the one whose other columns sort last, wherever
        it comes from).  Returns the number of buckets written.

        ``max`` of a struct is a partial aggregate, so changes with many rows of
        one key are combined before the exchange.
        """
        rest = [c for c in changes.columns if c not in (self.key, version)]
        best = F.max(F.struct(version, *rest)).alias("_row")
        if not path_exists(self.spark, self.path):
            self.create(changes.groupBy(self.key).agg(best).select(self.key, "_row.*"))
            return len(self.touched(changes))
        touched = self.touched(changes)
        if touched:
            old = self.stored(touched).drop("bucket").select(self.key, version, *rest)
            rows = old.unionByName(changes).groupBy(self.key).agg(best).select(self.key, "_row.*")
            self._write(rows.withColumn("bucket", self.bucket()), "dynamic")
        return len(touched)

    def update_greatest(self, deltas: DataFrame, column: str) -> int:
        """``column`` of stored rows becomes the greatest of itself and the
        deltas of its key; keys that are not stored change nothing (UPDATE)."""
        new = deltas.groupBy(self.key).agg(F.max(column).alias("_new"))
        touched = self.touched(deltas)
        if touched:
            old = self.stored(touched)
            rows = old.join(new, self.key, "left").withColumn(column, F.greatest(column, "_new")).select(*old.columns)
            self._write(rows, "dynamic")
        return len(touched)

    def _write(self, rows: DataFrame, mode: str) -> None:
        if mode == "dynamic":
            # the new buckets are complete in the shared folder before the old ones go
            rows = materialize(rows)
        w = rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
        if mode == "dynamic":
            w = w.option("partitionOverwriteMode", "dynamic")
        w.parquet(self.path)


# -- checked appends ----------------------------------------------------------------

@dataclass(frozen=True)
class Constraints:
    """What a stored row must satisfy, checked in this order.

    ``checks``: (reason, column expression that must be true; NULL counts as
    false); ``references``: (reason, column, referenced table, its key; a NULL
    reference is allowed); ``unique``: a key that no stored row and no earlier
    accepted row of the batch may have; ``order``: who comes first among equal
    keys of a batch.
    """

    checks: list[tuple[str, Column]] = field(default_factory=list)
    references: list[tuple[str, str, DataFrame, str]] = field(default_factory=list)
    unique: str | None = None
    unique_reason: str = "duplicate_key"
    order: list[str] = field(default_factory=list)
    #: keys that are taken though no batch stored them
    taken: DataFrame | None = None


def not_null(columns: list[str]) -> list[tuple[str, Column]]:
    """NOT NULL checks (F12), one reason per column."""
    return [(f"{c}_is_null", F.col(f"`{c}`").isNotNull()) for c in columns]


def earlier_batches(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The rows that batches before ``batch_id`` stored (a replay must not see
    its own), or None."""
    if not path_exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("batch_id") < batch_id)


def judge(batch: DataFrame, rules: Constraints, stored: DataFrame | None = None) -> DataFrame:
    """``batch`` with ``reason``: NULL for rows that may be stored, else the first
    constraint they violate."""
    if rules.unique is not None:  # tells rows apart that are equal in all of ``order``
        batch = materialize(batch.withColumn("_row", F.monotonically_increasing_id()))
    cols = batch.columns
    reason = F.lit(None).cast("string")
    for name, ok in reversed(rules.checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    rows = batch.withColumn("reason", reason)
    for name, column, parent, key in rules.references:
        known = parent.select(F.col(key).alias("_parent")).distinct()
        rows = rows.join(known, F.col(column) == F.col("_parent"), "left")
        orphan = F.col(column).isNotNull() & F.col("_parent").isNull()
        rows = rows.select(*cols, F.coalesce("reason", F.when(orphan, F.lit(name))).alias("reason"))
    if rules.unique is None:
        return rows
    taken = [d.select(F.col(rules.unique).alias("_taken")) for d in (stored, rules.taken) if d is not None]
    if taken:
        held = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
        rows = rows.join(held.distinct(), F.col(rules.unique) == F.col("_taken"), "left")
        clash = F.when(F.col("_taken").isNotNull(), F.lit(rules.unique_reason))
        rows = rows.select(*cols, F.coalesce("reason", clash).alias("reason"))
    # the first free row of a key: a partial aggregate and an equi-join, no window over a hot key
    place = F.struct(*rules.order, "_row")
    first = rows.where(F.col("reason").isNull() & F.col(rules.unique).isNotNull())
    first = first.groupBy(F.col(rules.unique).alias("_key")).agg(F.min(place).alias("_first"))
    rows = rows.join(first, F.col(rules.unique) == F.col("_key"), "left")
    late = F.when(place != F.col("_first"), F.lit(rules.unique_reason))
    return rows.select(*cols, F.coalesce("reason", late).alias("reason")).drop("_row")


def append_checked(batch: DataFrame, batch_id: int, path: str, rules: Constraints, store=None) -> None:
    """Append the rows of a batch that satisfy ``rules`` to ``<path>/accepted``,
    the others with their ``reason`` to ``<path>/rejected``.

    ``store`` maps the accepted rows to what is stored (default: as they are;
    it must keep the unique key).  Every row of the batch is in exactly one of
    the tables, once per batch id.
    """
    spark = batch.sparkSession
    judged = materialize(judge(batch, rules, earlier_batches(spark, f"{path}/accepted", batch_id)))
    good = judged.where(F.col("reason").isNull()).drop("reason")
    write_batch(store(good) if store else good, f"{path}/accepted", batch_id)
    write_batch(judged.where(F.col("reason").isNotNull()), f"{path}/rejected", batch_id)
