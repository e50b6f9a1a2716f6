"""Sharding against the same Feistel network in plain Python."""

import math
import struct
import zlib

import xxhash

from treeledger.llm import sharding as S


def _hash(*values: tuple[str, int], seed: int = 42) -> int:
    """The chained 64-bit hash of ints ("i") and longs ("q"), signed."""
    h = seed
    for kind, v in values:
        h = xxhash.xxh64_intdigest(struct.pack(f"<{kind}", v), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def _network(x: int, rows: int, seed: int) -> int:
    b = max(1, math.isqrt(max(0, rows - 1)) + 1)
    a = max(1, -(-rows // b))
    while True:
        left, right = divmod(x, b)
        for i in range(S.ROUNDS):
            if i % 2 == 0:
                left = (left + _hash(("i", seed), ("i", i), ("q", right)) % a) % a
            else:
                right = (right + _hash(("i", seed), ("i", i), ("q", left)) % b) % b
        x = left * b + right
        if x < rows:
            return x


def test_digest_against_plain_python(spark):
    texts = ["x" * (i % 7) for i in range(210)] + [None, "", "é" * 3]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = S.shard_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    n = len(rows)
    places = sorted(_network(x, n, 17) for x in range(n))
    assert places == list(range(n))
    assert sorted(r.slot * 16 + r.shard for r in got) == places
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)
    counts = [sum(r.shard == s for r in got) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def test_global_rows_go_where_the_network_sends_them(spark):
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(150)], "doc_id long, text string")
    for r in S.shard(frame).collect():
        p = _network(r.global_row, 150, 17)
        assert (r.shard, r.slot) == (p % 16, p // 16)
