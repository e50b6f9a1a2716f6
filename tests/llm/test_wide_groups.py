import random

import numpy as np

from treeledger.llm import ngram_join


def links_by_brute_force(rows):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_groups_beyond_a_block(spark, monkeypatch):
    """Texts that share passages chain into groups of many blocks; copies inside them must still be found, and only those."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 900)
    rng, texts = random.Random(3), []
    passages = [[f"p{i}x{j}" for j in range(30)] for i in range(6)]
    for i in range(60):
        words = [f"u{i}w{j}" for j in range(rng.randint(40, 160))]
        for q in rng.sample(range(6), 2):
            at = rng.randint(0, len(words))
            words[at:at] = passages[q]
        texts.append(words)
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"c{rng.randint(0, 9999)}"
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = ngram_join.ngram_join_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == links_by_brute_force(rows)


def test_no_postings():
    none = np.zeros(0, ngram_join._POSTING)
    assert ngram_join._by_bucket(none["h"], 6, none).num_rows == 0


def test_long_lists_are_thinned_to_one_posting_of_each_size_and_stay_connected():
    x = np.zeros(3000, ngram_join._POSTING)
    x["h"] = np.repeat([7, 9], [2600, 400])
    x["fp"], x["n"], x["p"] = np.arange(3000), np.arange(3000) % 13 + 40, 3
    left, edges = ngram_join._thinned(x.copy())
    assert (left["h"] == 9).sum() == 400 and sorted(left["n"][left["h"] == 7]) == list(range(40, 53)) and (left["p"][left["h"] == 7] == 0).all()
    kept = set(left["fp"].tolist())
    joined = {int(f) for e in edges for f in (e["a_fp"], e["b_fp"])}
    assert kept | joined == set(range(3000)) and all(e["a_n"] == e["b_n"] for e in edges)
