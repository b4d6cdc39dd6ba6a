import subprocess
import sys

import pytest

from parley import session


def test_the_callers_checkpoint_folder_is_used(spark, scratch):
    held = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(scratch)
    try:
        mine = spark.sparkContext.getCheckpointDir()
        assert session.ensure_checkpoint_dir(spark) == mine and scratch in mine
        assert session.scratch_path(spark, "x").startswith(mine)
        assert session.materialize(spark.range(3)).count() == 3
        assert spark.sparkContext.getCheckpointDir() == mine
    finally:
        if held:
            spark.sparkContext.setCheckpointDir(held)


def test_a_cluster_must_name_a_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_the_setting_is_read(scratch):
    code = f"""
import sys; sys.path.insert(0, {repr(sys.path[0])}); sys.path.insert(0, '.')
from pyspark.sql import SparkSession
from parley.session import ensure_checkpoint_dir
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {scratch!r}).getOrCreate()
print("DIR", ensure_checkpoint_dir(s))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert scratch in out.stdout.split("DIR", 1)[1], out.stderr[-2000:]
