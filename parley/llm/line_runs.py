"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased, as 128 hash bits (two XXH64 with different seeds).  Documents come
in batches by descending ``doc_id``.  A batch's keys, counted per key, are
merge-anti-joined with every run: a key that a run holds with ``min_docs``
documents is settled, because the run also holds its largest ``doc_id``, and
costs nothing any more.  What is left becomes a sorted run of level 0.
``fanout`` runs of a level are merged into one of the next.  At the end the runs
that are left are merged once more, and lines are dropped by equi-joins.

A run is a Parquet table bucketed and sorted by key under ``spark.checkpoint.dir``,
so that a join with it moves the batch only.  Only DataFrame operations are
used; the driver sees the cuts between batches and one row count.

Hot lines: keys are counted before they are shuffled.  Keys of so many documents
that few can exist (at most ``hot_keys``, by arithmetic) are broadcast to the
final join, all others are joined by a shuffle.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` counts
as one document, smaller than all others; rows that share a ``doc_id`` count as
one document (each loses its lines as if alone, and all rows of the largest
``doc_id`` keep theirs); a line repeated in one document counts once and all its
copies share its fate; an empty table gives an empty result; result columns
replace columns of the same name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import materialize, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: a null doc_id, before every other
NO_ID = -(2**63)


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case and nothing else (``lower`` is the quick way where all
    characters are ASCII)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def document_id(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def text_id(c: Column) -> Column:
    return F.xxhash64(c)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, t, h1, h2, at): the keys of a document's lines with their positions,
    one row per key of a row (equal rows share one).

    The copies of a line within a document meet in the partial aggregate.
    """
    lines = docs.select(document_id(F.col("doc_id")).alias("id"), text_id(F.col("text")).alias("t"),
                        F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.char_length("line") >= min_chars)
    key = lower_ascii(F.col("line"))
    lines = lines.select("id", "t", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    return lines.groupBy("id", "t", *KEY).agg(F.collect_set("pos").alias("at"))


class LineRuns:
    """Sorted runs (h1, h2, n_docs, last_id) in levels.

    Batches must be added by descending ids.  The runs are tables of a database
    in the shared folder; a merged run is dropped once its successor is written.
    """

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int | None = None, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"parley_lines_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.written = 0
        self.folder = scratch_path(spark, self.database)
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.folder}'")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def unsettled(self, counted: DataFrame, large: int) -> DataFrame:
        """The counted keys that no run holds with enough documents, and those
        of ``large`` documents or more: one sort-merge anti-join per run, on the
        run's own buckets."""
        for run in self.runs():
            done = self.spark.table(run).where(F.col("n_docs") >= self.min_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
            same = (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("n_docs") < large)
            counted = counted.join(done.hint("merge"), same, "left_anti")
        return counted

    def add(self, lines: DataFrame, large: int = 2**62) -> None:
        """The next batch of lines (id, h1, h2): what the runs have not settled
        becomes a run, and full levels are merged.  Settled keys of ``large``
        documents in this batch are counted on, so that frequent keys are known."""
        counted = lines.groupBy(*KEY).agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("last_id"))
        self._write(self.unsettled(counted, large), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(level)
            level += 1

    def merged(self) -> DataFrame:
        """Every key of all runs, its documents counted and its largest id."""
        return self._sum(self.runs())

    def repeated(self) -> DataFrame:
        """The keys of at least ``min_docs`` documents, as a table of their own;
        the runs are dropped."""
        out = materialize(self.merged().where(F.col("n_docs") >= self.min_docs))
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")
        return out

    def _sum(self, runs: list[str]) -> DataFrame:
        # read as plain files: Spark 4.1 takes a union of bucketed tables for dealt by
        # key without pairing their buckets, and an aggregate over it comes out wrong
        folders = [f"{self.folder}/{r.split('.')[1]}" for r in runs]
        rows = self.spark.read.schema("h1 long, h2 long, n_docs long, last_id long").parquet(*folders)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))

    def _merge(self, level: int) -> None:
        old = self.levels[level]
        self._write(self._sum(old), level + 1)
        self.levels[level] = []
        for r in old:
            self.spark.sql(f"DROP TABLE {r}")

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"{self.database}.run_{self.written}"
        self.written += 1
        dealt = rows.select(*KEY, "n_docs", "last_id").repartition(self.buckets, *KEY)
        dealt.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.levels[level].append(name)


def batch_cuts(docs: DataFrame, batches: int) -> list[int]:
    """At most ``batches - 1`` ids that deal the documents evenly."""
    at = [i / batches for i in range(1, batches)]
    if not at:
        return []
    cuts = docs.agg(F.percentile_approx(document_id(F.col("doc_id")), at).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def dropped_lines(lines: DataFrame, repeated: DataFrame, pairs: int, hot_keys: int) -> DataFrame:
    """(id, t, dropped): the positions that a document loses.

    Of ``pairs`` (document, key) at most ``hot_keys`` keys can hold more than
    ``pairs / hot_keys`` each.  The runs miss less than that of a settled key,
    so no key that is not broadcast has more than twice as many rows.
    """
    least = pairs // hot_keys + 1
    last = repeated.select(*KEY, "n_docs", "last_id")
    hot = F.broadcast(last.where(F.col("n_docs") >= least).select(*KEY, "last_id"))
    rest = last.where(F.col("n_docs") < least).select(*KEY, "last_id")
    found = lines.join(hot, KEY).unionByName(lines.join(hot.select(*KEY), KEY, "left_anti").join(rest, KEY))
    gone = found.where(F.col("id") != F.col("last_id"))
    return gone.groupBy("id", "t").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("dropped"))


def flags(dropped: Column) -> Column:
    """true at the dropped positions, false up to the last of them."""
    before = F.concat(F.array(F.lit(-1)), F.slice(dropped, F.lit(1), F.size(dropped) - 1))
    gaps = F.arrays_zip(dropped.alias("at"), before.alias("before"))
    return F.flatten(F.transform(gaps, lambda g: F.concat(
        F.array_repeat(F.lit(False), g["at"] - g["before"] - 1), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 8, fanout: int = 4,
                hot_keys: int = 10_000) -> DataFrame:
    """``docs`` (doc_id, text, ...) without repeated lines.

    Lines whose key has ``min_chars`` code points or more and occurs in at least
    ``min_docs`` documents stay in the largest ``doc_id`` that holds them.
    ``n_lines`` counts a text's lines before, ``n_dropped`` those that went.
    The number of batches is a parameter, so that a larger corpus has larger
    batches and every step stays in proportion to it.
    """
    spark = docs.sparkSession
    cuts = batch_cuts(docs, batches)
    batch = F.lit(0)
    for c in cuts:  # batch 0 holds the largest ids
        batch = batch + F.when(F.col("id") < c, 1).otherwise(0)
    folder = scratch_path(spark, f"lines-{uuid.uuid4().hex[:12]}")
    keyed_lines(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
    stored = spark.read.schema("id long, t long, h1 long, h2 long, at array<int>, batch int").parquet(folder)

    sizes = {r["batch"]: r["count"] for r in stored.groupBy("batch").count().collect()}  # one number per batch
    runs = LineRuns(spark, min_docs, fanout=fanout)
    for i in range(len(cuts) + 1):
        runs.add(stored.where(F.col("batch") == i).select("id", *KEY), sizes.get(i, 0) // hot_keys + 1)
    gone = dropped_lines(stored.drop("batch"), runs.repeated(), sum(sizes.values()), hot_keys)
    gone = gone.select("id", "t", flags(F.col("dropped")).alias("gone"), F.size("dropped").cast("long").alias("n"))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       document_id(F.col("doc_id")).alias("id"), text_id(F.col("text")).alias("t"))
    rows = rows.join(gone, ["id", "t"], "left")
    text = F.col("row").getField("text")
    kept = F.array_join(F.filter(lines_of(text), lambda x, i: ~F.coalesce(F.get(F.col("gone"), i), F.lit(False))), "\n")
    new = {"text": F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept),
           "n_lines": F.size(lines_of(text)).cast("long"), "n_dropped": F.coalesce("n", F.lit(0).cast("long"))}
    old = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return rows.select(*old, *[v.alias(k) for k, v in new.items()])
