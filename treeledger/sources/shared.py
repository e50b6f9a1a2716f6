"""Tables in the cluster's shared folder: where lineage is cut, and a lost executor loses nothing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``.

    Where that setting is absent and all tasks run on this machine, as in
    tests, a temporary folder takes its place; a cluster without a shared
    folder is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, f"c-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder and read again, so that it is computed once and plans stay short."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
