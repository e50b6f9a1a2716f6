"""A stored trigram index: a table of postings in partitions by trigram, with deltas that are appended and merged."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grams import pack, runs, unpack
from ..sources.shared import cut
from . import search as S

BUCKETS = 256
#: The partition of the rows that name a block's contents.
CONTENTS = -1
#: Files that each bucket of a delta is dealt to, by block: a trigram that most contents hold is spread over so many tasks; and files of the contents.
SPREAD, CONTENTS_SPREAD = 4, 64
#: Blocks with fewer postings are united when deltas are merged, to about twice as many.
SMALL = 1 << 19


def _bucket(trigram: Column, buckets: int) -> Column:
    return F.when(trigram.isNull(), CONTENTS).otherwise(F.pmod(F.xxhash64(trigram), F.lit(buckets))).cast("int")


def _write(index: DataFrame, path: str, buckets: int) -> None:
    rows = index.withColumn("bucket", _bucket(F.col("trigram"), buckets))
    spread = F.pmod(F.xxhash64("block"), F.when(F.col("bucket") == CONTENTS, CONTENTS_SPREAD).otherwise(SPREAD))
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "trigram").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(path)


def add(extracts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Appends the postings of new contents (sha256, text) as a delta. A content that is added twice is posted twice, which changes no answer."""
    _write(S.trigram_index(extracts), path, buckets)


def _united(key, lists: pa.Table, held: pa.Table) -> pa.Table:
    """Lists of some blocks as lists of one: places that are held get their new number, all others go."""
    names = {b: i for i, b in enumerate(dict.fromkeys(held.column("block").to_pylist()))}
    code = lambda t: np.fromiter((names[b] for b in t.column("block").to_pylist()), np.int64, len(t))
    which, place = unpack(lists.column("places").to_pylist())
    old, new = code(held) << 32 | held.column("place").to_numpy(), held.column("to").to_numpy()
    order = np.argsort(old)
    old, new = old[order], new[order]
    asked = code(lists)[which] << 32 | place
    at = np.minimum(np.searchsorted(old, asked), len(old) - 1)
    kept = old[at] == asked
    said = lists.column("trigram").combine_chunks().dictionary_encode()
    said = said.combine_chunks() if isinstance(said, pa.ChunkedArray) else said
    found = said.indices.to_numpy(zero_copy_only=False).astype(np.int64)[which[kept]] << 32 | new[at[kept]]
    found.sort()
    starts = runs(found >> 32)
    grams = said.dictionary.take(pa.array(found[starts] >> 32))
    return pa.table({"trigram": grams.cast(pa.string()), "block": pa.array([key[0].as_py()] * len(starts), pa.string()), "places": pa.array(pack(found & 0xFFFFFFFF, starts), pa.binary())})


def merge(spark: SparkSession, path: str, into: str, contents: DataFrame, buckets: int = BUCKETS) -> None:
    """Writes the index at ``path`` anew: each posting once, only those of ``contents`` (sha256) that are still there, small blocks united, sorted by trigram."""
    index = spark.read.parquet(path)
    held = index.filter(F.col("bucket") == CONTENTS).join(contents.select("sha256").distinct(), "sha256", "left_semi")
    once = cut(held.groupBy("sha256").agg(F.min(F.struct("block", "place", "n")).alias("at")).select("sha256", "at.*"))
    sizes = cut(once.groupBy("block").agg(F.sum("n").alias("n")))
    total = sizes.filter(F.col("n") < SMALL).agg(F.sum("n")).first()[0] or 0
    united = F.concat(F.lit(uuid.uuid4().hex[:12] + "-"), F.pmod(F.xxhash64("block"), F.lit(-(-total // (2 * SMALL)) or 1)).cast("string"))
    blocks = cut(sizes.select("block", F.when(F.col("n") < SMALL, united).otherwise(F.col("block")).alias("united")))
    number = F.row_number().over(W.partitionBy("united").orderBy("block", "place")) - 1
    placed = cut(once.join(blocks, "block").withColumn("to", number))
    lists = index.filter(F.col("bucket") != CONTENTS).select("trigram", "block", "places").join(blocks, "block")
    lists = lists.groupBy("united").cogroup(placed.select("united", "block", "place", "to").groupBy("united")).applyInArrow(_united, "trigram string, block string, places binary")
    none = lambda kind: F.lit(None).cast(kind)
    _write(lists.select("trigram", "block", none("string").alias("sha256"), none("int").alias("place"), none("long").alias("n"), "places"), into, buckets)
    _write(placed.select(none("string").alias("trigram"), F.col("united").alias("block"), "sha256", F.col("to").cast("int").alias("place"), "n", none("binary").alias("places")), into, buckets)


def _asked(spark: SparkSession, path: str, grams: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """The lists of some trigrams, of whose buckets only the row groups that may hold them are read; and the contents."""
    asked = spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g"), buckets).alias("b")).distinct().collect()  # a row a trigram of the question
    index = spark.read.parquet(path)
    return index.filter(F.col("bucket").isin([r.b for r in asked]) & F.col("trigram").isin(grams)), index.filter(F.col("bucket") == CONTENTS)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _places(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: unpack([x])[1])


def postings(spark: SparkSession, path: str, grams: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(trigram, sha256) of some trigrams, each once."""
    lists, contents = _asked(spark, path, grams, buckets)
    return lists.select("trigram", "block", F.explode(_places("places")).alias("place")).join(contents.select("block", "place", "sha256"), ["block", "place"]).select("trigram", "sha256").distinct()


def matches(spark: SparkSession, path: str, extracts: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Contents of ``extracts`` that hold every term, by the stored index; candidates are verified, terms under 3 characters are verified only.

    Contents that aren't in the index yet aren't found: ``add`` them first.
    """
    grams = S.trigrams_of(terms)
    if not grams:
        return S.text_matches(extracts, terms)
    lists, contents = _asked(spark, path, grams, buckets)
    return S.indexed_matches(lists.unionByName(contents).drop("bucket"), extracts, terms)
