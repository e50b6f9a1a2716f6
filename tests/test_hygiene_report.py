from treeledger.operators import history
from treeledger.operators import hygiene as H
from treeledger.plans import clean_up as C

ENTRY = "root string, relpath string, is_dir boolean, size long, mtime_ns long, sha256 string, hashed_size long, hashed_mtime_ns long"
YEAR = 365 * 86_400_000_000_000


def entries(spark, rows):
    return spark.createDataFrame([("r", p, d, s, m, None, None, None) for p, d, s, m in rows], ENTRY)


def test_all_rules_report_each_path_once(spark):
    rows = [(f"app/data/{i}", False, 2, 9) for i in range(3)] + [(f"node_modules/deep/{i}", False, 2, 9) for i in range(9)]
    rows += [("empty", True, 0, 7), ("node_modules/void", True, 0, 7), ("__pycache__", True, 0, 7)]
    rows += [("photos.zip", False, 50, 9), ("photos/a.jpg", False, 1, 9), ("alone.zip", False, 50, 9)]
    rows += [("big.mov", False, 100, 1), ("new.mov", False, 100, 3 * YEAR), ("big.iso", False, 100, 1), ("old.zip", False, 100, 1), ("old/x.jpg", False, 1, 9)]
    e = entries(spark, rows)
    found = H.findings(e, now_ns=3 * YEAR, least_bare=3, stale_bytes=100)
    got = sorted((r.category, r.relpath, r.is_dir, r.files, r.size, r.needs_review) for r in found.collect())
    assert got == [
        ("app-data", "app/data", True, 3, 6, False),
        ("empty-dir", "empty", True, 0, 0, False),
        ("extracted-archive", "old.zip", False, 1, 100, True),
        ("extracted-archive", "photos.zip", False, 1, 50, True),
        ("installer", "big.iso", False, 1, 100, False),
        ("regenerable", "__pycache__", True, 0, 0, False),
        ("regenerable", "node_modules", True, 9, 18, False),
        ("stale-large", "big.mov", False, 1, 100, True),
    ]
    ops = {(o.path, o.files, o.size, o.mtime_ns) for o in C.build(found, e).collect()}
    assert {("app/data", 3, 6, 9), ("empty", 0, 0, 7)} <= ops


def test_spared_paths_keep_the_folders_above_them(spark):
    rows = [("a/node_modules/x.js", False, 2, 9), ("a/node_modules/deep/cache/y", False, 3, 9), ("b/node_modules/z.js", False, 4, 9)]
    rows += [(f"bare/{i}", False, 2, 9) for i in range(3)] + [("bare/sub/keep me", False, 2, 9), ("void", True, 0, 7), ("void2", True, 0, 7)]
    rows += [("pic.zip", False, 50, 9), ("pic/a.jpg", False, 1, 9), ("big.iso", False, 100, 1), ("plan v1.doc", False, 7, 9), ("plan v2.doc", False, 7, 9), ("plan v3.doc", False, 7, 9), ("v/old/t.doc", False, 5, 9)]
    e = entries(spark, rows)
    kept = spark.createDataFrame([("r", "a/node_modules/x.js"), ("r", "void"), ("r", "bare/sub")], "root string, path string")
    spared = history.kept_or_allowed(e, kept, ["*.zip"])
    pairs = [("r", "plan v1.doc", "plan v2.doc"), ("r", "plan v1.doc", "plan v3.doc"), ("r", "plan v2.doc", "plan v9.doc"), ("r", "v/old", "v"), ("r", "b/node_modules/z.js", "v"), ("r", "bare", "v")]
    versions = spark.createDataFrame(pairs, "root string, old string, newer string")
    found = H.findings(e, now_ns=3 * YEAR, least_bare=3, stale_bytes=100, spared=spared, versions=versions, disabled=["installer"])
    got = sorted((r.category, r.relpath, r.is_dir, r.files, r.size, r.needs_review) for r in found.collect())
    assert got == [
        ("app-data", "a/node_modules/deep/cache", True, 1, 3, False),
        ("empty-dir", "void2", True, 0, 0, False),
        ("old-version", "plan v1.doc", False, 1, 7, False),
        ("old-version", "v/old", True, 1, 5, False),
        ("regenerable", "b/node_modules", True, 1, 4, False),
        ("stale-large", "big.iso", False, 1, 100, True),
    ]
    assert [r.newer for r in H.old_versions(e, versions).filter("relpath = 'plan v1.doc'").collect()] == ["plan v3.doc"]
