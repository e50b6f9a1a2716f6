"""The prefix trie against plain Python over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from treeledger.llm import prefix_trie as P

ROWS = "conv_id long, turn long, role string, text string, pos string, node long"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(int(c / 20) * 20, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, q in built.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    children = defaultdict(list)
    for q in members:
        if q:
            children[q[:-1]].append(q)
    total = {}
    for q in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        leaves = sum(total[k][0] for k in children[q]) or 1
        total[q] = (leaves, (len(members[q]) - 1) * words + sum(total[k][1] for k in children[q]))
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (min(m), len(q), min(members[q[:-1]]) if q else None, len(m), len(children[q]), *total[q], sha(sorted(c for c in m if len(built[c]) == len(q))))
        for q, m in members.items()
    )


def digest(frame):
    key = lambda r: (r[0], r[1])
    return sorted((tuple(r) for r in P.trie(frame).collect()), key=key)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-45, 150):
        if c % 20 == 0 and c % 3 == 0:
            continue  # no base
        if c % 7 == 0:  # copies of one conversation
            rows += [(c, t, "user", f"same turn {t}") for t in range(4)]
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "bot", None]), rng.choice(["a b", "a  b\tc", "", None, "word"])))
    rows += [(3, 50 + t, "user", f"deep {t % 2}") for t in range(45)] + [(4, 50 + t, "user", f"deep {t % 2}") for t in range(30)]
    rows += [(5, 9, "bot", "again")] * 6 + [(None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize(("seed", "piece"), [(1, P.PIECE), (2, 16)])
def test_against_plain_python(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(6)
    assert digest(frame) == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_one_conversation_holds_most_rows(spark):
    """Positions in a conversation that goes over many ranges, equal rows among them."""
    rows = [(1, t // 3, "user", "same") for t in range(300)] + [(c, 0, "user", f"{c}") for c in range(2, 60)]
    got = P.turns(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(5)).filter("conv_id = 1")
    assert sorted(r.pos for r in got.collect()) == list(range(1, 301))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = P.turns(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(5)).groupBy(F.spark_partition_id()).count()
        assert max(r["count"] for r in tasks.collect()) < 250
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_common_end_goes_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 50)
    ends = spark.range(2000).select(F.when(F.col("id") < 1900, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).cast("binary").alias("node"), F.col("id").alias("conv_id"))
    got = {bytes(r.node).decode(): r.sha for r in P.hashed_lists(ends.repartition(7)).collect()}
    held = defaultdict(list)
    for i in range(2000):
        held["hot" if i < 1900 else f"k{i % 7}"].append(i)
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in held.items()}


def test_empty_and_turnless(spark):
    assert digest(spark.createDataFrame([], ROWS)) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    assert digest(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
