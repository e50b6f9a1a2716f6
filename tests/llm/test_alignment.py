"""Token alignment against a plain version that encodes whole texts and compares all tokens."""

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from treeledger.llm import alignment as A

TEXTS = [
    "Plain words, and more plain words: don't stop.",
    "two  spaces   three    four ",
    "  leads with spaces",
    " ",
    "\t\n \n mixed \n  white space \r\n ends\n",
    "<|endoftext|> and <s> </s> <unk> <0x41> stay text <|endoftext|>",
    "Ünïcode straße 漢字かな交じり文 emoji 👩‍👩‍👧 é ​ zero",
    "a▁b has the mark of a space",
    "x" * 3000 + "\n" * 9000 + "é" * 5000 + " " + "1234567890" * 50,
    "the the the the the of of of",
    "\x00\x01 control \x1c \x1f end",
    "para graph 　 wide",
    "﻿bom 'S 's don't WE'LL we'll",
]


def plain(texts: dict[int, str | None]) -> dict[int, tuple]:
    a, b = A._tokenizer(A.A_FILE), A._tokenizer(A.B_FILE)
    model = Tokenizer.from_file(A.A_FILE)
    model.encode_special_tokens = True
    rows = {}
    for i, text in texts.items():
        ids = [[], []]
        if text:
            ids = [model.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)]
            wanted = (" " + text).encode()
            if any(b"".join(t.bytes[x] for x in k) != wanted for t, k in zip((a, b), ids, strict=True)):
                ids = [[], []]
        spans = []
        for t, k in zip((a, b), ids, strict=True):
            at, out = 0, []
            for x in k:
                out.append((at, at := at + len(t.bytes[x]), x))
            spans.append(out)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        groups, lo = [], 0
        for cut in sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]}):
            groups.append("|".join(",".join(str(x[2]) for x in s if lo < x[1] <= cut) for s in spans))
            lo = cut
        rows[i] = (len(ids[0]), len(ids[1]), groups, links)
    counts = Counter(x for r in rows.values() for x in r[3])
    most = Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    return {
        i: (n_a, n_b, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, (n_a, n_b, g, x) in rows.items()
    }


@pytest.mark.parametrize("head", [A.HEAD, 40, 0])
def test_digest_against_whole_texts(spark, monkeypatch, head):
    monkeypatch.setattr(A, "SLICE", 900)
    monkeypatch.setattr(A, "UNITS", 30)
    texts = dict(enumerate([*TEXTS, None, "", TEXTS[0], TEXTS[9]]))
    frame = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, n_a long").repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in A.alignment_digest(frame, head=head).collect()}
    assert got == plain(texts)
    assert got[7] == (0, 0, 0, 0, 0, 0, "") and got[0][0] > 0


def test_columns_repeats_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "one two", "x", "mine"), (1, "one two", "x", None), (1, "one two", "x", None), (2, None, None, None)], "doc_id long, text string, groups string, other string")
    rows = A.align(frame).collect()
    assert [r.other for r in rows] == ["mine", None, None, None]
    assert len({r.groups for r in rows[:3]}) == 1 and "|" in rows[0].groups and rows[3].groups == ""
    assert all(sum(r.times) == r.n_links and r.pairs == sorted(r.pairs) for r in rows)
    digest = A.alignment_digest(frame).collect()
    assert len(digest) == 4 and len({r[1:] for r in digest if r.n_a}) == 1
    assert A.alignment_digest(frame.limit(0)).collect() == []


def test_units_join_to_the_texts():
    import pyarrow as pa

    units, offs = A.units_of(pa.array([t for t in TEXTS if t]))
    held = [t for t in TEXTS if t]
    assert [" ".join(units[lo:hi]) for lo, hi in zip(offs[:-1], offs[1:], strict=True)] == held


def test_splits_like_the_file_on_every_character():
    a, model = A._tokenizer(A.A_FILE), Tokenizer.from_file(A.A_FILE)
    model.encode_special_tokens = True
    for lo in range(1, 0x110000, 1 << 14):
        texts = [f"a{c}1{c}! {c}'s" for c in map(chr, range(lo, min(lo + (1 << 14), 0x110000))) if not 0xD800 <= ord(c) < 0xE000]
        if texts:
            assert max(map(len, texts)) < A.LONG
            assert [x.ids for x in model.encode_batch([" " + t for t in texts], add_special_tokens=False)] == a.encode(texts)
