"""Session helpers.

The library never creates its own cluster settings beyond sane defaults:
on a real cluster the session already exists and carries
``spark.checkpoint.dir`` (a shared folder); locally we fill in what is
missing so tests and the bench run the same code.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # broadcast only what is provably small; dimension tables here are
    # rule catalogs of a few hundred rows, fact tables are never broadcast
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "parley") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.executorEnv.PYTHONWARNINGS", "ignore::FutureWarning")
    b = b.config("spark.driver.memory", os.environ.get("PARLEY_DRIVER_MEMORY", "8g"))
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A folder that the caller set (``setCheckpointDir`` or the
    ``spark.checkpoint.dir`` setting) is used as it is.  Where there is none,
    a local session gets a temporary one; a cluster must name a folder that
    all executors share, so that is an error.
    """
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        return held
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="parley-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df, eager: bool = True):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared
    ``spark.checkpoint.dir`` (survives executor loss; never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
