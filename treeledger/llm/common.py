"""Column builders and helpers that the corpus operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words made of ASCII letters and digits and of all other characters.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A token: a run of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would change other letters too)."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Lower-cased words of a whole text as an array; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the cluster's shared checkpoint folder.

    The session's ``spark.checkpoint.dir`` is used. Only where it is unset and
    all tasks run on this machine, as in tests, a temporary folder takes its
    place; a cluster without a shared folder is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, f"t-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each (name, column) of ``sums``, the column's sum over all rows before in ``order``.

    Rows are dealt by ranges of the order, which has to tell them apart; only
    one row per range is brought together for the ranges' offsets.
    """
    dealt = written(df.select("*", *[c.cast("long").alias(f"{n}_v") for n, c in sums.items()]).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("__range").agg(*[F.sum(f"{n}_v").alias(f"{n}_t") for n in sums])
    offsets = offsets.select("__range", *[F.coalesce(F.sum(f"{n}_t").over(before), F.lit(0)).alias(f"{n}_o") for n in sums])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    held = dealt.select("*", *[F.coalesce(F.sum(f"{n}_v").over(inside), F.lit(0)).alias(f"{n}_i") for n in sums]).join(F.broadcast(offsets), "__range")
    return held.select(*df.columns, *[(F.col(f"{n}_i") + F.col(f"{n}_o")).alias(n) for n in sums])


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of jobs that have ended.

    Spark's cleaner deletes them once the driver's garbage collector finds the
    plans unused; a driver with memory to spare may not collect for many large
    shuffles in a row. The latest query's plan is held until another one has
    run, hence the small one. Plans that are still held, and written tables,
    stay.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def most_frequent(counts: DataFrame, key: str, count: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (long) and counts of the rows with the highest counts: all above the count that at most ``most`` reach.

    A histogram of counts (16 bars to a factor of e) gives the bound first, so
    the driver receives no more rows than it keeps. ``counts`` is read twice.
    """
    barred = counts.select(key, count).withColumn("__bar", F.floor(F.log(count) * 16))
    bars = barred.groupBy("__bar").agg(F.count(F.lit(1)).alias("__n"))
    over = bars.withColumn("__up", F.sum("__n").over(W.orderBy(F.desc("__bar")).rowsBetween(W.unboundedPreceding, 0)))
    least = over.filter(F.col("__up") <= most).agg(F.min("__bar")).first()[0]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = barred.filter(F.col("__bar") >= least).select(key, count).toArrow()
    return got.column(key).to_numpy(), got.column(count).to_numpy()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that uses names with two leading underscores for itself: columns of the input that bear such a name are kept under another one meanwhile."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        aside: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__"):
                name = f"kept{c}"
                while name in docs.columns:
                    name = f"kept_{name}"
                aside[c] = name
        out = stage(docs.withColumnsRenamed(aside), *args, **more)
        return out.withColumnsRenamed({name: c for c, name in aside.items()})

    return run
