"""Append-only JSONL logs as tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

EVENT = "at string, host string, op string, root string, path string, tag string, source string, src string, dst string, name string, value string"


def numbered(rows: DataFrame, order: list[Column], into: str = "seq") -> DataFrame:
    """``rows`` numbered from 1 in ``order``, which tells them apart; dealt by ranges, with one count a range brought together."""
    names = [f"__o{i}" for i in range(len(order))]
    dealt = cut(rows.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)]).repartitionByRange(*names).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*names))
    return dealt.withColumn("__inside", inside).join(F.broadcast(offsets), "__range").select(*rows.columns, (F.col("__before") + F.col("__inside")).cast("long").alias(into))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of all files, lines from 0; blank ones are counted and left out.

    Files are read in splits: a line's number is its place in its split plus
    the lines of the file's splits before, so that a large file is read by many
    tasks and its lines keep their order.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = cut(rows)
    splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = rows.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"])
    # the rows of a split follow one another in one task, so their places differ by one
    return held.select("file", (F.col("before") + F.col("place") - F.col("first")).alias("line"), "text").filter(F.trim(F.regexp_replace("text", "[\r\t]", " ")) != "")


def read(spark: SparkSession, path: str, schema: str = EVENT, required: str | None = "op") -> DataFrame:
    """Events of all files in one order, ``seq`` from 1: by ``at`` (missing sorts first), then file, then line.

    Blank and broken lines are skipped, and those that aren't objects or lack
    the ``required`` field. A file is one writer's log; a half-written last
    line counts as broken until it is whole.
    """
    rows = lines(spark, path).select("file", "line", F.from_json("text", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("e"))
    rows = rows.filter("e IS NOT NULL AND e.__bad IS NULL").select("file", "line", "e.*").drop("__bad")
    if required:
        rows = rows.filter(F.col(required).isNotNull())
    at = F.coalesce(F.col("at"), F.lit("")) if "at" in rows.columns else F.lit("")
    return numbered(rows, [at, F.col("file"), F.col("line")])


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def latest_extracts(extracts: DataFrame) -> DataFrame:
    """One extract per content, the newest (an upsert by sha256)."""
    newest = W.partitionBy("sha256").orderBy(F.desc("created_at"), "method")
    return extracts.withColumn("r", F.row_number().over(newest)).filter("r = 1").drop("r")
