"""Counts against plain Python, and learnt lists on planted labels."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeledger.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
        len(lines), len(re.findall("[0-9]", text)), len(re.findall("[A-Z]", text)), max(map(len, words), default=0),
    )


def texts(seed, n=120):
    rng = random.Random(seed)
    pool = ["a", "B", "é", "漢字", "#x", "12", "a|b", " ", " ", "word"]
    out = [None, "", " ", "\n\n", "\n", "x", "x\n", "\nx", "a a a a a a", "a b c d e\r\na b c d e\r\n", "same\nsame\n same\n\n \nsame", "q " * 3000, "z" * 5000]
    for _ in range(n):
        out.append("".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(40))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts(monkeypatch, seed):
    from treeledger.llm import textbytes

    held = texts(seed)
    monkeypatch.setattr(textbytes.chunks, "__defaults__", (200,))
    assert [tuple(r) for r in Q.count_texts(pa.array(held, pa.string())).tolist()] == [plain(t) for t in held]


def rows(n, seed=5):
    """Good texts; bad ones have signs in them, or very long words."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 60))]
        bad = i % 4 == 0
        if i % 8 == 0:
            words = [w + "$%" if rng.random() < 0.4 else w for w in words]
        elif bad:
            words = [w * 9 for w in words]
        out.append((i, " ".join(words), int(not bad)))
    return out


def test_learnt_list_on_other_rows(spark):
    held = rows(1200)
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t, _ in held], "doc_id long, text string, rule string, n_words int")
    labels = spark.createDataFrame([(i, q) for i, _, q in held if i < 600], "doc_id long, quality int")
    counted = Q.statistics(docs)
    rules = Q.learn_rules(counted, labels)
    assert 1 <= len(rules) <= 4 and all(r.right >= Q.PRECISION * r.covered for r in rules)
    got = {r.doc_id: r for r in Q.judge(counted, rules).collect()}
    wrong = [i for i, _, q in held if i >= 600 and got[i].kept != bool(q)]
    assert len(wrong) <= 6, [str(r) for r in rules]
    # the expression is the list in order, and equals the same list over numpy
    names = list(Q.features())
    values = np.array([list(r)[1:] for r in counted.select("doc_id", *[v.alias(k) for k, v in Q.features().items()]).orderBy("doc_id").collect()], float)
    first = np.zeros(len(values), int)
    for i, rule in enumerate(rules, 1):
        first[(first == 0) & rule.mask(values, names)] = i
    assert [got[i].rule or 0 for i in range(1200)] == [0 if got[i].base_failed else int(first[i]) for i in range(1200)]


def test_bounded_sample_and_order_independence(spark):
    held = rows(400)
    docs = Q.statistics(spark.createDataFrame([(i, t) for i, t, _ in held], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, q) for i, _, q in held], "doc_id long, quality int")
    other = spark.range(1000, 90_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"))
    assert [str(r) for r in Q.learn_rules(docs, labels, 80)] == [str(r) for r in Q.learn_rules(docs.repartition(5), labels.union(other).repartition(3), 80)] != []


def test_odd_labels_and_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "x " * 40), (3, "x " * 40), (4, " ".join(map(str, range(50))))], "doc_id long, text string")
    for labels in ([], [(None, 0), (1, None), (4, 7)], [(4, 1), (4, 0), (3, 0)]):
        got = Q.quality_digest(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in got) == [(0, 2, True, False), (1, 0, True, False), (2, 0, True, False), (3, 40, True, False), (3, 40, True, False), (4, 50, False, True)]
    assert Q.quality_digest(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, quality int")).collect() == []
