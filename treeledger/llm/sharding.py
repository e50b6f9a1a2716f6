"""Sharding by a Feistel permutation of global row numbers.

Every row gets a global number from 0 to N-1, a keyed Feistel network over
Z_a x Z_b (a*b >= N) permutes the numbers, and a number that leaves the range
is sent through the network again until it is back (cycle walking). The place
of a row is then arithmetic: ``shard = p mod shards``, ``slot = p div shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

ROUNDS, WALK = 6, 64


def numbered(df: DataFrame, order: list[str], rows: int, per_bucket: int = 500_000, into: str = "global_row") -> DataFrame:
    """Adds the gapless global row number, the same however ``df`` is partitioned.

    Rows are hashed by their ``order`` columns into buckets of about
    ``per_bucket`` rows and numbered inside each; only one count per bucket
    (N / per_bucket rows) is brought together for the bucket's offset. Rows
    equal in all order columns are interchangeable.
    """
    buckets = max(256, -(-rows // per_bucket))
    held = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = held.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("__b", F.coalesce(before, F.lit(0)).alias("__o"))
    rank = F.row_number().over(W.partitionBy("__b").orderBy(*order))
    return held.withColumn("__r", rank).join(F.broadcast(offsets), "__b").withColumn(into, F.col("__o") + F.col("__r") - 1).drop("__b", "__r", "__o")


def _once(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network: halves (l in Z_a, r in Z_b), each shifted in turn by a hash of the other."""

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), i, s["r"]), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), i, s["l"]), F.lit(b)), F.lit(b))
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def permuted(x: Column, rows: int, seed: int) -> Column:
    """The Feistel permutation of 0..rows-1 at ``x``.

    a*b exceeds ``rows`` by less than b, so a walk of WALK steps outside is
    impossible below WALK**2 rows and has a chance under WALK**-WALK beyond;
    it would raise an error, never give a wrong place.
    """
    b = max(1, math.isqrt(max(0, rows - 1)) + 1)
    a = max(1, -(-rows // b))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _once(x, a, b, seed), lambda y, _: F.when(y < rows, y).otherwise(_once(y, a, b, seed)))
    return F.when(walk < rows, walk).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def shard(docs: DataFrame, shards: int = 16, seed: int = 17, order: list[str] | None = None) -> DataFrame:
    """Adds ``global_row``, ``shard`` (counts at most one apart) and ``slot`` (gapless from 0).

    The permutation depends on the rows, ``seed`` and N only. Null ids or
    texts, empty texts and repeated rows are rows like any other; an empty
    table gives an empty result. Columns named like the added ones are
    replaced.
    """
    docs = docs.drop("global_row", "shard", "slot")
    rows = docs.count()
    key = [] if order else [F.xxhash64(*docs.columns).alias("__k")]
    order = order or ["__k"]
    held = numbered(docs.select("*", *key), order, max(rows, 1)).drop("__k")
    place = held.withColumn("__p", permuted(F.col("global_row"), max(rows, 1), seed))
    return place.withColumn("shard", F.pmod("__p", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("__p") / shards).cast("long")).drop("__p")


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """op10: where each document goes; law ``rows``, so ``grown_shard`` is null. A null text has size 1 and crc32 0."""
    text = F.col("text")
    keys = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard(written(keys), shards, seed, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
