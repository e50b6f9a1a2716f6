import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from treeledger.llm import decontaminate, language_model, licenses, mixing, ngram_join, repeats, sharding, topk, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, global_row long, shard long, __score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, 8, "x") for i, t, s in rows], DOC)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = [f"a{i}" for i in range(60)]
ODD = [
    (1, None, "b"), (None, "one two three", None), (2, "", None), (3, LONG, "a"), (4, LONG, "a"), (4, LONG, "a"),
    (5, " ".join(BASE), "a"), (6, " ".join(BASE[:-2] + ["z"]), "b"), (7, "x", "b"), (8, "X ", "b"), (9, "the MIT License, mit-license", "é"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_shard(odd, none):
    rows = sharding.shard(odd, 4).collect()
    assert sorted(r.shard + 4 * r.slot for r in rows) == list(range(len(ODD)))
    again = sharding.shard(odd.repartition(5), 4).collect()
    assert sorted((r.doc_id or 0, r.shard, r.slot) for r in rows) == sorted((r.doc_id or 0, r.shard, r.slot) for r in again)
    assert sharding.shard_digest(none).collect() == []
    for r in sharding.shard_digest(odd).collect():
        text = next(t for i, t, _ in ODD if i == r.doc_id) or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)


@pytest.mark.parametrize("n", [1, 2, 17, 1000])
def test_permutation(spark, n):
    assert sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 3)).collect()) == list(range(n))


def test_mix(odd, none):
    rows = mixing.mix_digest(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows)
    total = sum(r.size for r in rows)
    per = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in per) - total) < 1e-6 * total and all(t <= 3 * s + 1e-9 for s, t in per)
    assert mixing.mix_digest(none).collect() == []


def test_decontaminate(spark, odd, none):
    bench = spark.createDataFrame([(10, " ".join(BASE[5:17])), (2, "One, TWO"), (3, None), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate_digest(odd, bench).collect()}
    assert (got[5].n_hit, got[5].n_items, got[5].contaminated) == (12, 1, True)
    assert (got[None].n_hit, got[None].n_words) == (2, 3) and got[1].n_words == 0 and not got[7].contaminated
    left = sorted((r.doc_id for r in decontaminate.decontaminate(odd, bench).collect()))
    assert left == [1, 2, 3, 4, 4, 7, 8, 9]
    assert decontaminate.decontaminate(none, bench).collect() == []


def test_licenses(odd, none):
    got = {r.doc_id: r for r in licenses.licenses_digest(odd).collect()}
    r = got[9]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (5, 2, 1, 3, "mit", "mit", 1.0)
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels, got[1].score) == (0, 0, None, "", 0.0)
    assert licenses.licenses_digest(none).collect() == []


def test_license_notices(spark):
    notice = {label: text for label, text, _ in licenses.NOTICES}
    words = notice["mit"].split()
    edited = words[:-4] + ["of", "this", "work"]  # the end differs, the key phrase stands
    broken = " ".join(words).replace("modify merge", "modify or merge")
    rows = [(1, "Preamble: " + notice["agpl-3.0"].upper()), (2, notice["gpl-3.0"]), (3, " ".join(edited)), (4, broken), (5, notice["lgpl-2.1"]), (6, notice["apache-2.0"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: {(licenses.catalog()[c.t]["label"], len(licenses.catalog()[c.t]["words"])): c for c in r["__found"]} for r in licenses.scan(docs).collect()}
    labels = {i: {k[0] for k in f} for i, f in found.items()}
    assert "agpl-3.0" in labels[1] and "gpl-3.0" not in labels[1]
    assert "gpl-3.0" in labels[2] and not {"gpl-2.0", "agpl-3.0", "lgpl-3.0"} & labels[2]
    assert "lgpl-2.1" in labels[5] and "lgpl-3.0" not in labels[5] and "apache-2.0" in labels[6]
    assert licenses.COVERAGE <= found[3][("mit", len(words))].coverage < 1 and found[2][("gpl-3.0", len(notice["gpl-3.0"].split()))].coverage == 1
    assert ("mit", len(words)) not in found[4]
    assert len(licenses.idf(docs)) == len(licenses.vocabulary())


def brute_components(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_ngram_join(spark, odd, none):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.ngram_join_digest(odd).collect()), key=str)
    assert (5, 56, 5) in got and (6, 55, 5) in got and (7, 1, 7) in got and (8, 1, 7) in got and (1, 0, 1) in got and len(got) == len(ODD)
    kept = sorted(r.doc_id or 0 for r in ngram_join.drop_near_duplicates(odd).collect())
    assert kept == [0, 1, 2, 3, 5, 7, 9]
    assert ngram_join.ngram_join_digest(none).collect() == []


def test_ngram_join_with_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = []
    for i in range(90):
        w = [f"t{i // 45}q{k}" for k in range(80)]
        for e in range(i % 5):
            w[(i * 13 + e * 17) % 80] = f"e{i}{e}"
        rows.append((i, " ".join(w), "s"))
    want = brute_components(rows)
    low = {}
    for i, (_, c) in enumerate(want):
        low.setdefault(c, i)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join_digest(docs(spark, rows)).collect()}
    assert got == {i: (n, low[c]) for i, (n, c) in enumerate(want)}


def test_repeats(odd, none):
    got = {r.doc_id: r for r in repeats.repeats_digest(odd).collect()}
    assert (got[3].n_repeated, got[3].spans) == (30_000, "0-30000") and got[5].spans == "0-58" and got[6].spans == "0-58"
    assert got[1].n_words == 0 and got[7].spans == "" and repeats.repeats_digest(none).collect() == []


def test_language_model(odd, none):
    got = language_model.score(odd).collect()
    train = [(i, t) for i, t, _ in ODD if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = collections.Counter(x for _, t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or 0, len(tokens(t)), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 3)) for i, t, _ in ODD)
    assert sorted((r.doc_id or 0, r.n_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert language_model.score(none).collect() == []


def test_toxicity(spark, odd, none):
    words = [f"plain{i % 40}" for i in range(60)]
    rows = [(i, " ".join(words[i % 30 :] + (["grobnix", "grobtal"][i % 2 : i % 2 + 1] if i % 3 == 0 else [])), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    frame = docs(spark, rows + [(900, "plain1 plain2 grobnux plain3", "s"), (901, "plain4 plain5", "s"), (902, None, "s")])
    got = {r.doc_id: r for r in toxicity.toxicity_digest(frame, labels).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(300) if got[i].held_out)
    assert got[900].score > got[901].score and 0 <= got[902].score <= 1
    assert toxicity.toxicity_digest(none, labels.limit(0)).collect() == []
    assert len(toxicity.toxicity_digest(odd, labels).collect()) == len(ODD)


def test_topk(spark):
    rows = [(i, [float((i * 7) % 11) / 10, float(i % 5) / 4]) for i in range(60)] + [(60, None), (61, [float("nan"), 1.0]), (62, [None, 1.0]), (None, [1.0, 1.0]), (3, [0.9, 0.75])]
    rows += [rows[10], rows[50], rows[10]]  # repeated rows: candidates of their own, but one query
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    good = sorted((i, tuple(math.floor(x * 256) for x in v)) for i, v in rows if i is not None and v and None not in v and not any(map(math.isnan, v)))
    want = []
    for q, a in sorted(set(good)):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.topk_digest(df).collect()) == want
    assert topk.topk_digest(df.limit(0)).collect() == []


def test_warc(spark):
    schema = "record_id long, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [
        (1, "HTTP://A.com:80/x/?b=1&utm_s=2&a=0#f", 1, 200, '"e"', None, "d1", {"date": "1", "content-type": "t"}),
        (2, "https://a.com/x?a=0&b=1", 2, 304, 'W/"e"', None, None, {"date": "2", "content-type": "n"}),
        (3, "http://a.com/x?a=0&b=1", 3, 304, '"f"', None, None, None),
        (4, None, 4, 304, '"e"', None, None, None),
        (5, "http://a.com/x?a=0&b=1", 0, 304, '"e"', None, None, None),
        (6, "http://a.com/x?a=0&b=1", 5, 304, None, None, None, {}),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert (got[2].base_id, got[2].outcome, got[2].headers, got[2].digest) == (1, "validated", {"date": "2", "content-type": "t"}, "d1")
    assert [got[i].outcome for i in (3, 4, 5, 6)] == ["mismatch", "no base", "no base", "unvalidated"]
    assert warc.resolve(spark.createDataFrame([], schema)).collect() == []


def test_decontamination_by_a_shuffle_agrees(spark, monkeypatch):
    rng = __import__("random").Random(2)
    items = [(f"i{i}", " ".join(f"b{rng.randrange(40)}" for _ in range(rng.randrange(0, 25)))) for i in range(30)] + [(None, "b1 b2 b3"), ("x", None), ("y", "B1, b2; b3")]
    docs = []
    for i in range(80):
        words = [f"b{rng.randrange(40)}" for _ in range(rng.randrange(0, 40))]
        if i % 3:
            words += (rng.choice(items)[1] or "").split()
        docs.append((i, " ".join(words + ["b1", "b2", "b3"][: i % 4]), "t"))
    docs += [(5, docs[5][1], "t"), (90, None, "t"), (91, "", "t")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, w string"), spark.createDataFrame(items, "item_id string, text string")
    want = []
    split = lambda t: __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {}
    for item, text in items:
        w = split(text)
        n = min(len(w), 10)
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add(item)
    for i, text, _ in docs:
        w, hit, ids = split(text), set(), set()
        for n in range(1, 11):
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids |= wins[tuple(w[p : p + n])]
        want.append((i, len(w), len(hit), sorted(ids - {None})))
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
        got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.overlaps(frame, bench).collect()]
        assert sorted(got) == sorted(want)
