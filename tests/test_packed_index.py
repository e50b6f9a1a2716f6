"""Trigrams and pairs of many texts as numbers, packed lists, and the stored index in blocks, against plain Python."""

import random
import re
from collections import Counter

from treeledger.functions import grams as G
from treeledger.functions.text import fold
from treeledger.operators import postings as I
from treeledger.operators import search as S


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcß日𝒳 é1") for _ in range(rng.randrange(30))) for _ in range(n)] + ["", "ab"]


def _grams(text):
    return {text[i : i + 3] for i in range(len(text) - 2)}


def test_trigrams_and_packed_lists(monkeypatch):
    texts = _texts(700, 1)
    want = {(g, i) for i, t in enumerate(texts) for g in _grams(t)}
    for most in (G.BYTES, 100):  # also in many pieces
        monkeypatch.setattr(G, "BYTES", most)
        got = []
        for a, _, grams, starts, places in G.trigrams(texts):
            which, at = G.unpack(G.pack(places, starts))
            assert at.tolist() == places.tolist() and len(grams) == len(starts)
            got += [(grams[w], a + p) for w, p in zip(which.tolist(), at.tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want
    assert list(G.trigrams(["ab"]))[0][2] == [] and G.pack(places[:0], starts[:0]) == []


def test_pairs_of_letters():
    texts = _texts(300, 2)
    offsets, pairs, counts = G.pairs(texts)
    for i, t in enumerate(texts):
        want = Counter()
        for w in re.findall(r"[^\W\d_]+", t):
            want.update([ord(x) << 21 | ord(y) for x, y in zip(w, w[1:], strict=False)] or [ord(w) << 21])
        assert dict(zip(pairs[offsets[i] : offsets[i + 1]].tolist(), counts[offsets[i] : offsets[i + 1]].tolist(), strict=True)) == want


def test_index_in_blocks(spark, tmp_path, monkeypatch):
    """A row of the index is a list of a block's contents, not a posting, however deltas overlap and blocks are united."""
    monkeypatch.setattr(I, "SMALL", 2000)
    rows = [(f"s{i:04}", t) for i, t in enumerate(_texts(900, 3))]
    paths = [str(tmp_path / x) for x in ("deltas", "merged", "again")]
    for a, b in ((0, 500), (400, 800), (700, 902)):
        I.add(spark.createDataFrame(rows[a:b] + rows[a : a + 9] + [("none", None)], "sha256 string, text string"), paths[0], 8)
    left = [r for i, r in enumerate(rows) if i % 3]
    frame = spark.createDataFrame(left, "sha256 string, text string")
    I.merge(spark, paths[0], paths[1], frame, 8)
    I.merge(spark, paths[1], paths[2], frame.filter("sha256 > 's0100'"), 8)
    asked = ["abc", "日𝒳x", "ss1", "éab"]
    for path, held in zip(paths, (rows, left, [r for r in left if r[0] > "s0100"]), strict=True):
        want = {(g, s) for s, t in held for g in _grams(fold(t))}
        got = I.postings(spark, path, sorted({g for g, _ in want}), 8).collect()
        assert len(got) == len(want) and {(r.trigram, r.sha256) for r in got} == want
        frame = spark.createDataFrame(held, "sha256 string, text string")
        for term in asked:
            assert sorted(r.sha256 for r in I.matches(spark, path, frame, [term, "b"], 8).collect()) == sorted(s for s, t in held if fold(term) in fold(t) and "b" in fold(t))
    postings = len({(g, s) for s, t in left for g in _grams(fold(t))})
    table = spark.read.parquet(paths[1])
    assert table.filter("bucket >= 0").count() < postings / 2 and table.filter("bucket < 0").count() == len(left)


def test_candidates_beyond_a_broadcast(spark, monkeypatch):
    rows = [(f"s{i:04}", t) for i, t in enumerate(_texts(300, 4))]
    frame = spark.createDataFrame(rows, "sha256 string, text string")
    want = sorted(s for s, t in rows if "ab" in fold(t) and "abc" in fold(t))
    for few in (S.FEW, 0):
        monkeypatch.setattr(S, "FEW", few)
        assert want and sorted(r.sha256 for r in S.indexed_matches(S.trigram_index(frame), frame, ["ABC", "ab"]).collect()) == want


def test_no_row_for_each_posting_of_a_search(spark):
    rows = [(f"s{i:04}", t) for i, t in enumerate(_texts(300, 5))]
    index = S.trigram_index(spark.createDataFrame(rows, "sha256 string, text string").coalesce(1))
    grams = {g for _, t in rows for g in _grams(fold(t))}
    assert index.filter("trigram IS NOT NULL").count() == len(grams) < sum(len(_grams(fold(t))) for _, t in rows) / 2
    assert index.filter("trigram IS NULL").agg({"n": "sum"}).first()[0] == sum(len(_grams(fold(t))) for _, t in rows)
