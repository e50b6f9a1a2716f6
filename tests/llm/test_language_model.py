"""The language model's size follows the corpus, its choices are a distribution, and what precedes a token tells it from others."""

import random

import numpy as np
from pyspark.sql import functions as F

from treeledger.llm import language_model as L


def _head(words: int = 2000, others: int = 1000) -> L.Head:
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(1, 1 << 63, words + others).astype(np.uint64))
    head = L.Head(h[:words], rng.integers(1, 50, words), 40, words + others)
    rest = np.zeros(head.leaves)
    np.add.at(rest, head.items(h[words:])[0] - words - 1, 2)
    head.close(rest)
    return head


def test_probabilities_of_all_items_sum_to_one_for_a_trained_history():
    head = _head()
    item = np.arange(len(head.h) + 1 + head.leaves, dtype=np.uint64)
    n = np.where(np.arange(len(item)) % 7 == 0, np.arange(len(item)) % 11, 0)
    p = L.fit(head, (np.uint64(5) << np.uint64(40)) | (np.uint64(9) << np.uint64(20)) | item, n)
    assert abs((np.exp(p) * 10**head.share).sum() - 1) < 1e-3
    assert np.exp(p)[n > 5].mean() > 3 * np.exp(p)[n == 0].mean()


def test_items_leaves_and_depth_grow_with_the_vocabulary():
    small, large = _head(20, 10), _head(20_000, 20_000)
    assert large.depth >= small.depth + 8 and large.leaves > 100 * small.leaves


def _score(frame):
    return {r.doc_id: r for r in L.score(frame).collect()}


def test_scores_do_not_depend_on_partitions_and_beat_the_base(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        at = rng.randrange(3000)
        rows.append((i, " ".join(f"w{(at + k) % 3000}" for k in range(300))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = _score(frame.coalesce(1)), _score(frame.repartition(13))
    assert {k: r.score for k, r in one.items()} == {k: r.score for k, r in many.items()}
    held = [r for r in one.values() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    # half of log10(3000) a token and less; the base knows the words' frequencies only
    assert sum(r.score for r in held) / tokens > -1.5 and sum(r.base_score for r in held) / tokens < -3


def test_units_and_shards_of_one_corpus_agree(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(0, 400)))) for i in range(200)]
    rows += [(1000 + i, None if i % 2 else "") for i in range(4)] + [(5, rows[5][1])] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    whole = _score(frame)
    monkeypatch.setattr(L, "UNIT", 3000)
    assert {k: r.score for k, r in _score(frame).items()} == {k: r.score for k, r in whole.items()}
    monkeypatch.setattr(L, "SHARD", 4096)
    got = L.score(frame).filter("not held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b
    assert len({r.score for r in L.score(frame).filter("doc_id = 5").collect()}) == 1
