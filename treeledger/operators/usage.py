"""Usage summaries and evaluation samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import cost_usd


def summary(usage: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Calls, tokens, seconds, cost and unpriced calls per (model, purpose)."""
    cost = cost_usd(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"), prices)
    return usage.withColumn("cost", cost).groupBy("model", "purpose").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.count(F.when(F.col("cost").isNull(), 1)).alias("unpriced")
    )


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows dealt round-robin over the strata, each in a seeded order; larger strata first in a round."""
    order = W.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    ranked = rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).join(sizes, stratum)
    return ranked.orderBy("__r", F.desc("__n"), stratum).limit(n).drop("__r", "__n")
