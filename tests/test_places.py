"""Destinations by date, and paths in an item tree of any depth."""

from treeledger.operators import browse as B
from treeledger.operators import decide as D


def test_dated_destinations(spark):
    rows = [
        ("領収書/2022年/2022年08月", "20250414", "領収書/2025年/2025年04月", "moved"), ("a/2022", "20250414", "a/2025", "new"), ("b/2022", "20250414", "b/2022", ""), ("2022", "20250414", "2025", "new"), ("a/202208", "20250414", "a/202504", "new"),
        ("a/2022-08", "20250414", "a/2025-04", "new"), ("a/202208_report", "20250414", "a/202208_report", ""), ("a/2022", None, "a/2022", ""), ("a/2022", "", "a/2022", ""), ("a/2025", "20250414", "a/2025", ""),
    ]
    known = spark.createDataFrame([("r", "a"), ("r", "領収書/2025年/2025年04月"), ("q", "b")], "root string, dir string")
    got = D.dated_destinations(spark.createDataFrame([("r", *r[:2]) for r in rows], "root string, dest string, date string"), known)
    assert sorted((r.dest, r.date or "", r.adjusted, r.note) for r in got.collect()) == sorted((d, t or "", a, n) for d, t, a, n in rows)


def test_deep_cloud_paths(spark):
    items = spark.createDataFrame([("i0", "N0", None)] + [(f"i{k}", f"n{k}", f"i{k - 1}") for k in range(1, 15)] + [("x", "é", "i0")], "id string, name string, parent string")
    deep = "/".join(f"n{k}" for k in range(15))
    got = B.cloud_paths(items, spark.createDataFrame([(deep,), ("n0/N1",), ("n0/é",), ("n0/none/n2",)], "path string"))
    assert {r.path: r.item_id for r in got.collect()} == {deep: "i14", "n0/N1": "i1", "n0/é": "x"}
    assert B.cloud_paths(items, spark.createDataFrame([], "path string")).collect() == []
