"""What operators need of the session: a shared folder and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (local
    runs) a new temporary folder is taken.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes a table that is used more than once, and keeps it where a lost executor doesn't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
