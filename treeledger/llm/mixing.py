"""Mixing sources to target weights.

Tokens are summed per source, targets and repetition rates follow from the
sums, and each document is emitted floor(rate) times plus once more if a hash
of it, read as a number in [0, 1), is below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_tokens, own_names, running, written

CAP = 3
#: Source rows up to which their table is broadcast; beyond, Spark's skew join splits hot sources.
BROADCAST_ROWS = 200_000


def targets(sizes: DataFrame, weights: int = 3) -> DataFrame:
    """``target`` for each row (source, source_size); the sources are distinct.

    Sources by code point, null last, weigh 1..weights, repeating. A target is
    min(cap, level * weight) with the level at which all targets sum to the
    sum of sizes: with the sources in order of cap / weight, those before the
    first whose share fits below its cap are at their caps. Both orders are
    running sums over ranges, so no task holds all sources.
    """
    order = [F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__name")]
    named = running(sizes.select("source", "source_size", *order), ["__none", "__name"], {"__rank": F.lit(1)})
    row = (
        named.withColumn("__w", F.pmod(F.col("__rank"), F.lit(weights)) + 1)
        .withColumn("__cap", F.col("source_size") * CAP)
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .select("source", "source_size", "__rank", "__w", "__cap", "__ratio")
    )
    row = running(row, ["__ratio", "__rank"], {"__before": F.col("__cap"), "__below": F.col("__w")})
    total, weight = row.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0))).first()
    level = (F.lit(total) - F.col("__before")) / (F.lit(weight) - F.col("__below"))
    first = row.withColumn("__level", level).filter(F.col("__level") <= F.col("__ratio")).agg(F.min(F.struct("__ratio", "__rank", "__level")).alias("m")).first()["m"]
    target = F.least(F.col("__cap").cast("double"), F.lit(float(first["__level"]) if first else 0.0) * F.col("__w"))
    return row.withColumn("target", target).select("source", "source_size", "target")


def planned(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    A null text has size 0, as has an empty one; a source without words keeps
    its documents once; a null source is a source of its own, the last. The
    draw hashes doc_id and text, so reruns agree and repeated rows get the
    same number of copies. A text is one row however long; an empty table
    stays empty; columns of other names than the added ones are kept. Sources
    whose caps are reached at the same level are settled by code point.
    """
    sized = docs.withColumn("__size", n_tokens(F.col("text")))
    per = written(targets(sized.groupBy("source").agg(F.sum("__size").alias("source_size"))))
    per = per.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    if per.count() <= BROADCAST_ROWS:
        per = F.broadcast(per)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rate = F.when(F.col("__source_size") > 0, F.least(F.col("__target") / F.col("__source_size"), F.lit(float(CAP)))).otherwise(F.lit(1.0))
    return (
        sized.join(per, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__rate", rate)
        .withColumn("__copies", F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1).otherwise(0))
        .drop("__source", "__rate")
    )


@own_names
def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document as often as the plan takes it, with its own columns."""
    kept = planned(docs, seed).filter(F.col("__copies") > 0)
    return kept.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def mix_digest(docs: DataFrame) -> DataFrame:
    """op3: per document its size, its source's size and target, and the words the mix takes of it."""
    return planned(docs.select("doc_id", "text", "source")).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).cast("long").alias("taken"),
    )


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, (rk - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM r),
o AS (SELECT *, cap::DOUBLE / w::DOUBLE AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::BIGINT - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
  / (sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM o),
f AS (SELECT coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rk LIMIT 1), 0.0) AS level),
t AS (SELECT source, source_size, least(cap::DOUBLE, f.level * w) AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 1.0::DOUBLE END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""
