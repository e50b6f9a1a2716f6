"""Exact top-k search by tiled matrix products.

Queries are packed into blocks and candidates into shards of bounded size. A
tile is one block against one shard: the blocks are written out once a shard,
so that tiles are spread by (block, shard) before any matrix is multiplied and
the shards are shuffled once. A tile keeps each query's best k, and a query's
lists are merged in a tree of ``FAN_IN`` lists at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Queries of a block, numbers (rows times components) of a shard, and lists that are merged at once.
BLOCK, SHARD, FAN_IN = 1024, 1 << 20, 16


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, dim, v): components floor(scale * x); rows with a null id or vector, or null or non-finite components, take no part.

    Repeated rows are rows of their own, as are rows that share an id only.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    scaled = lambda x: F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), x.cast("double") * scale))
    floor = lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))  # noqa: E731  beyond, doubles are whole
    return whole.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", floor).alias("v"))


def _matrix(rows) -> bytes:
    """Rows of numbers as 32-bit integers where all fit, else as doubles; the first byte tells which."""
    m = np.stack(rows.to_numpy()).astype(np.float64)
    small = np.abs(m).max(initial=0) < 2**31
    return (b"i" + m.astype(np.int32).tobytes()) if small else (b"d" + m.tobytes())


def _numbers(data: bytes, dim: int, rows: int) -> np.ndarray:
    kind = np.int32 if data[:1] == b"i" else np.float64
    return np.frombuffer(data, kind, offset=1).reshape(rows, dim).astype(np.float64)


def _packed(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """One row per group of vectors of the same length: (dim, group, ids, matrix); ``sizes``: the groups of each length."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], name: [int(pdf[name].iloc[0])], f"{name}_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], f"{name}_m": [_matrix(pdf["v"])]})

    # dealt by row, not by content: a vector that very many rows hold is spread as well
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn(name, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col(f"{name}s")).cast("int"))
    return dealt.select("dim", name, "vec_id", "v").groupBy("dim", name).applyInPandas(pack, f"dim int, {name} int, {name}_ids binary, {name}_m binary")


def _integers(m: np.ndarray) -> np.ndarray:
    """Whole numbers of any size."""
    out = np.empty(m.shape, object)
    out.flat = [int(x) for x in m.flat]
    return out


def _long(x) -> int:
    return max(-(2**63), min(2**63 - 1, int(x)))


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best per query; candidates come in order of id, which settles ties."""
    exact = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1)) < 2**53
    s = q @ c.T if exact else np.frompyfunc(_long, 1, 1)(_integers(q) @ _integers(c).T)
    own = q_ids[:, None] == c_ids[None, :]
    s = np.where(own, -np.inf, s)
    if exact and s.shape[1] > 4 * k:
        # candidates below the k-th best score cannot be in the list; ties with it all stay until the sort
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, col = np.nonzero(s >= floor[:, None])
    else:
        row, col = np.nonzero(np.ones(s.shape, bool))
    value = s[row, col]
    order = np.lexsort((col, -value, row)) if exact else np.array(sorted(range(len(row)), key=lambda i: (row[i], -value[i], col[i])), int)
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, np.arange(len(q_ids)))
    keep = (np.arange(len(row)) - first[row] < k) & (value != -np.inf)
    return q_ids[row[keep]], c_ids[col[keep]], value[keep]


def search(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products among the candidate rows, those of the query's own id left out.

    Both sides: (vec_id, dim, v). A query that is given twice has one list, as
    its candidates do not differ; two queries that share an id have one list
    of both. Inner products exist between vectors of one length only; ties go
    to the smaller id; a candidate row that is there twice is listed twice, and
    a row that shares a query's id is no candidate of it, twins included.
    Products are exact whatever the components; a score beyond 64 bits counts
    as the nearest bound. Columns of other names than vec_id and embedding are
    never read. Without queries or candidates the result is empty.
    """
    queries = queries.distinct()
    per = lambda df, name, size: df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    shards_of = written(per(candidates, "ss", F.greatest(F.lit(1), F.floor(F.lit(SHARD) / F.greatest("dim", F.lit(1))))))
    blocks_of = written(per(queries, "bs", F.lit(BLOCK)))
    shards, blocks = _packed(candidates, shards_of, "s"), _packed(queries, blocks_of, "b")
    spread = blocks.join(F.broadcast(shards_of), "dim").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("ss") - 1))).drop("ss")
    tiles = spread.join(shards, ["dim", "s"])

    def run(frames):
        for pdf in frames:
            for t in pdf.itertuples():
                q_ids, c_ids = np.frombuffer(t.b_ids, np.int64), np.frombuffer(t.s_ids, np.int64)
                q, c, v = best_of_tile(q_ids, _numbers(t.b_m, t.dim, len(q_ids)), c_ids, _numbers(t.s_m, t.dim, len(c_ids)), k)
                yield pd.DataFrame({"query_id": q, "g": np.full(len(q), t.s, np.int64), "vec_id": c, "score": np.array([int(x) for x in v], np.int64)})

    lists = tiles.mapInPandas(run, "query_id long, g long, vec_id long, score long")
    n = shards_of.agg(F.max("ss")).first()[0] or 1
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        lists = lists.withColumn("g", F.floor(F.col("g") / FAN_IN))
        best = W.partitionBy("query_id", "g").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_digest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """op8: the stated query set (ids divisible by ``every``) against all rows."""
    rows = written(quantized(embeddings))
    return search(rows.filter(F.col("vec_id") % every == 0), rows, k)


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
