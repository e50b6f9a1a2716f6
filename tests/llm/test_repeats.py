"""Repeated windows against brute force: many ranges, joined anchors, periodic texts, and partners that are no neighbours."""

import random
from collections import Counter

import pytest

from treeledger.llm import repeats as R


def _texts(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    passages = [[word() for _ in range(rng.randrange(14, 40))] for _ in range(6)]
    out = []
    for i in range(90):
        words = [word() for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            lo = rng.randrange(0, len(p) - 10)
            words += p[lo : lo + rng.randrange(8, 30)] + [word() for _ in range(rng.randrange(0, 6))]
        out.append((i, "  ".join(words) if i % 3 else " \n".join(words).upper()))
    out += [(200, "a b " * 40), (201, "x " * 50), (202, None), (203, ""), (204, "a\x01b c" * 9), (5, out[5][1]), (5, out[5][1])]
    return out


def _brute(rows, passage):
    seen = Counter()
    each = []
    for i, text in rows:
        words = (text or "").lower().split()
        starts = [tuple(words[s : s + passage]) for s in range(len(words) - passage + 1)]
        seen.update(starts)
        each.append((i, text, starts))
    return {(i, s) for i, text, starts in each for s, w in enumerate(starts) if seen[w] > 1}


@pytest.mark.parametrize(("size", "limit"), [(1 << 15, 32 << 20), (5, 0)])
def test_windows_that_repeat(spark, monkeypatch, size, limit):
    monkeypatch.setattr(R, "RANGE", size)
    monkeypatch.setattr(R, "BROADCAST_BYTES", limit)
    rows = _texts(size)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, s) for r in R.repeated_windows(frame, 12, 4).collect() for s in r.starts}
    assert got == _brute(rows, 12)


def test_an_anchor_of_many_pieces_is_compared_over_all_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE", 7)
    rng = random.Random(9)
    common = [f"c{j}" for j in range(9)]
    rows = [(i, " ".join([f"l{rng.randrange(3)}" for _ in range(6)] + common + [f"r{rng.randrange(3)}" for _ in range(6)])) for i in range(300)]
    got = {(r.doc_id, s) for r in R.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), 12, 4).collect() for s in r.starts}
    assert got == _brute(rows, 12)
