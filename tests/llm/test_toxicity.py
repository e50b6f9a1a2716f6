"""Training rows of the toxicity model, its scores against plain Python, and columns with clashing names."""

import numpy as np
import pyarrow as pa

from treeledger.llm import decontaminate, mixing, ngram_join
from treeledger.llm import toxicity as T

KINDS = "doc_id long, text string"


def corpus(n, seed=3):
    """(doc_id, text, toxic): toxic texts hold one of four invented words, sometimes misspelt."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["zorkwut", "vlixpost", "quazzit", "wurrgzot"]
    out = []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(15, 60)))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w = str(rng.choice(bad))
                text.insert(int(rng.integers(0, len(text))), w[:-1] + w[-1] * int(rng.integers(1, 3)))
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_sample_is_chosen_among_rows_with_texts(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(7, None), (None, "no id")], KINDS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    strangers = spark.range(10_000, 60_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    sizes = {1: 20, 0: 50}
    alone = sorted(tuple(r) for r in T.sample(docs, labels, sizes).collect())
    beside = sorted(tuple(r) for r in T.sample(docs.repartition(5), labels.union(strangers), sizes).collect())
    assert alone == beside and [sum(r[2] == v for r in alone) for v in (1, 0)] == [20, 50]
    assert all((i, t) == rows[i][:2] for i, t, _ in alone)  # whole texts


def test_sample_stops_after_so_many_characters(spark):
    docs = spark.createDataFrame([(i, "w " * 500) for i in range(100)], KINDS)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(100)], "doc_id long, toxic int")
    got = T.sample(docs, labels, chars={1: 4500, 0: 1}).collect()
    assert sorted(r.toxic for r in got) == [0, 1, 1, 1, 1, 1] and {len(r.text) for r in got} == {1000}
    many = spark.createDataFrame([(1, f"copy {i}") for i in range(60)], KINDS)
    assert T.sample(many, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), {1: 10, 0: 10}).count() == 10


def test_long_toxic_texts(spark):
    """The toxic words of a long text stand anywhere in it."""
    rows, rng = corpus(900, 5), np.random.default_rng(1)
    clean = [t for _, t, x in rows if not x]
    long = []
    for i, (_, text, _) in enumerate(r for r in rows if r[2]):
        parts = list(rng.choice(clean, 8 if i % 3 else 40))
        parts.insert(int(rng.integers(0, len(parts))), text)
        long.append((10_000 + i, " ".join(parts), 1))
    held = long + [r for r in rows if not r[2]] + [(20_000 + i, " ".join(rng.choice(clean, 8)), 0) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in held], KINDS)
    got = {r.doc_id: r for r in T.toxicity_digest(docs, spark.createDataFrame([(r[0], r[2]) for r in held], "doc_id long, toxic int")).collect()}
    apart = [(r[2], got[r[0]].predicted) for r in held if got[r[0]].held_out]
    found = [p for t, p in apart if t]
    assert len(found) > 20 and np.mean(found) > 0.9 and np.mean([p for t, p in apart if not t]) < 0.05


def plain_logit(text, table, bias):
    """The highest mean over the n-grams of six words in turn, word by word and n-gram by n-gram."""
    code = [0] + [(b | 32 if 65 <= b < 91 else b) if (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) else 0 for b in text.encode()] + [0] * 8
    starts = [i for i in range(len(code) - 1) if code[i] == 0 and code[i + 1]]
    best = None
    for lo in range(0, len(starts), 6):
        end = starts[lo + 6] if lo + 6 < len(starts) else len(code)
        values = []
        for i in range(starts[lo], end):
            for n in T.GRAMS:
                g = code[i : i + n]
                if len(g) == n and not any(c == 0 for c in g[1:-1]):
                    h = g[0]
                    for c in g[1:]:
                        h = (h * 0x01000193 + c) % 2**32
                    values.append(float(table[((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * (n - 1)) % 2**32) >> 14]))
        z = (sum(values) / len(values) if values else 0.0) + bias
        best = z if best is None else max(best, z)
    return bias if best is None else best


def test_scores_against_plain_python():
    table = np.random.default_rng(2).standard_normal(T.BUCKETS).astype(np.float32)
    texts = ["", "  ", "one", "Some MIXED case words, 12 and été", "a b c d e f g h i j k l m", "漢字 and x" * 9, None]
    got = T.text_logits(pa.array(texts, pa.string()), table, 0.25)
    assert np.allclose(got, [plain_logit(t or "", table, 0.25) for t in texts], atol=1e-5)


def test_clashing_columns_stay(spark):
    names = ["__score", "__th", "__id", "__gone", "__size", "__i", "__copies", "__h", "kept__i"]
    held = corpus(40)
    frame = spark.createDataFrame([(i, t, "s", *[f"{n}{i}" for n in names]) for i, t, _ in held], ", ".join(["doc_id long, text string, source string", *[f"{n} string" for n in names]]))
    frame = frame.unionByName(frame.filter("doc_id < 3"))
    labels = spark.createDataFrame([(i, x) for i, _, x in held], "doc_id long, toxic int")
    tests = spark.createDataFrame([("b", held[5][1])], "item_id string, text string")
    for out in (T.drop_toxic(frame, labels), ngram_join.drop_near_duplicates(frame), mixing.mix(frame), decontaminate.decontaminate(frame, tests)):
        rows = out.collect()
        assert out.columns == frame.columns and rows
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
