"""Cases at the edges of operators 8 and 9."""

from treeledger.llm import topk, warc

RECORD = "record_id long, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>, base string, canonical long"


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1e300, 1e300]), (4, [0.0, 1.0]), (50, [1e15, 3.0]), (51, [1e15, 1.0])]
    assert len(topk.topk_digest(spark.createDataFrame([(0, [1.7e308]), (1, [-1.7e308])], "vec_id long, embedding array<double>")).collect()) == 1
    got = topk.topk_digest(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")).collect()
    whole = {i: [int(x * 256 // 1) for x in v] for i, v in rows}
    for q in (0, 50):
        bound = lambda s: max(-(2**63), min(2**63 - 1, s))
        scores = sorted((-bound(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:5]
        want = [(r, i, -s) for r, (s, i) in enumerate(scores, 1)]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_twins_of_a_query(spark):
    rows = [(50, [1.0]), (50, [1.0]), (1, [1.0]), (1, [1.0])]
    got = topk.topk_digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(50, 1, 1), (50, 2, 1)]


def test_revisits_at_the_edges(spark):
    url = "http://a.example/x"
    rows = [
        (1, url, 1, 200, "e", None, "d", {"Date": "old", "ETag": "e", "x-own": "1", "Expires": None}, "mine", 7),
        (2, url, 2, 304, "e", None, None, {"DATE": "new", "etag": None, "Server": "s"}, None, None),
        (3, url, 3, 304, "e", None, None, None, None, None),
        (3, url, 3, 304, "e", None, None, None, None, None),
        (4, None, 3, 304, "e", None, None, {"date": "x"}, None, None),
        (5, url, None, 304, "e", None, None, None, None, None),
    ]
    got = warc.resolve(spark.createDataFrame(rows, RECORD)).collect()
    by_id = {r.record_id: r for r in got}
    assert len(got) == 5 and by_id[2].headers == {"DATE": "new", "ETag": "e", "x-own": "1", "Expires": None}
    assert by_id[3].outcome == "validated" and by_id[3].headers["Date"] == "old" and sum(r.record_id == 3 for r in got) == 2
    assert by_id[4].outcome == by_id[5].outcome == "no base" and by_id[4].headers == {"date": "x"}
    ties = [(1, url, 1, 200, "e", None, "a", {}, None, None), (1, url, 1, 200, "e", None, "b", {}, None, None), (2, url, 2, 304, "e", None, None, {}, None, None)]
    assert [r.digest in ("a", "b") for r in warc.resolve(spark.createDataFrame(ties, RECORD)).collect()] == [True]
    assert warc.resolve(spark.createDataFrame([], RECORD)).collect() == []
