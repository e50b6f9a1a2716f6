"""Plans against small trees and journals, and the states one after the other in plain Python."""

import random

from treeledger.plans import clean_up as C

SEEN = "root string, relpath string, is_dir boolean, inode long, size long, mtime_ns long"
TREE = [("r", "d", True, 1, 0, 5), ("r", "d/a.txt", False, 2, 10, 7), ("r", "d/e", True, 3, 0, 4), ("r", "d/b (1).txt", False, 4, 3, 9), ("r", "d/b.txt", False, 5, 3, 8), ("r", "Out/Name.txt", False, 6, 1, 1), ("r", "é/x", False, 7, 1, 1)]


def op(path, **more):
    held = {"root": "r", "path": path, "is_dir": False, "inode": None, "files": None, "size": None, "mtime_ns": None, "dest": None, "category": None, "requires": None, "requires_size": None, "requires_mtime_ns": None}
    return tuple((held | more).values())


OPS = "root string, path string, is_dir boolean, inode long, files long, size long, mtime_ns long, dest string, category string, requires string, requires_size long, requires_mtime_ns long"
CASES = [
    (op("gone"), "missing"),
    (op("d/a.txt", inode=9, size=10, mtime_ns=7), "replaced"),
    (op("d/a.txt", inode=2, size=11, mtime_ns=7), "changed"),
    (op("d/a.txt", inode=2, size=10, mtime_ns=7), None),
    (op("d", is_dir=True, inode=1, files=3, size=16, mtime_ns=9), None),
    (op("d", is_dir=True, inode=1, files=2, size=16, mtime_ns=9), "changed"),
    (op("d", is_dir=True, inode=1, files=3, size=16, mtime_ns=8), "changed"),
    (op("d/e", is_dir=True, inode=3, files=0, size=0, mtime_ns=4, category="empty-dir"), "not empty"),
    (op("Out", is_dir=True, files=1, size=1, mtime_ns=1, category="empty-dir"), "not empty"),
    (op("d/b (1).txt", size=3, mtime_ns=9, requires="d/c.txt", requires_size=3, requires_mtime_ns=8), "prerequisite missing"),
    (op("d/b (1).txt", size=3, mtime_ns=9, requires="d/b.txt", requires_size=4, requires_mtime_ns=8), "prerequisite changed"),
    (op("d/b (1).txt", size=3, mtime_ns=9, requires="d/b.txt", requires_size=3, requires_mtime_ns=8), None),
    (op("d/b (1).txt", size=3, mtime_ns=9, requires="d/b.txt", requires_size=-1), None),
    (op("d/a.txt", size=10, mtime_ns=7, dest="d/b.txt"), "destination exists"),
    (op("d/a.txt", size=10, mtime_ns=7, dest="Out"), "destination exists"),
    (op("d/a.txt", size=10, mtime_ns=7, dest="Out/name.TXT"), "case clash"),
    (op("d/a.txt", size=10, mtime_ns=7, dest="out/new.txt"), "case clash"),
    (op("d/a.txt", size=10, mtime_ns=7, dest="é/new.txt"), "case clash"),
    (op("d/a.txt", size=10, mtime_ns=7, dest="new/out/x"), None),
    (op("d/a.txt", size=10, mtime_ns=7, dest="d/A.txt"), None),
    (op("d/a.txt", size=10, mtime_ns=7, dest="D/a.txt"), None),
]


def test_first_problem(spark):
    """Each case in a root of its own."""
    roots = range(len(CASES))
    seen = spark.createDataFrame([(f"r{i}", *row[1:]) for i in roots for row in TREE], SEEN)
    others = spark.createDataFrame([(f"r{i}", "d/e/link") for i in roots], "root string, relpath string")
    got = {r.root: r.problem for r in C.check(spark.createDataFrame([(f"r{i}", *CASES[i][0][1:]) for i in roots], OPS), seen, others).collect()}
    assert [got[f"r{i}"] for i in roots] == [want for _, want in CASES]


def test_without_optional_columns(spark):
    seen = spark.createDataFrame(TREE, SEEN)
    ops = spark.createDataFrame([r for r, _ in CASES], OPS)
    few = ops.select("root", "path", "is_dir", "size", "mtime_ns").limit(4)
    assert sorted(str(r.problem) for r in C.check(few, seen).collect()) == ["None", "None", "changed", "missing"]


def test_build_leaves_out_what_no_longer_holds(spark):
    kinds = "root string, category string, relpath string, is_dir boolean, files long, size long, needs_review boolean"
    found = [("r", "conflict", "d/b (1).txt", False, 1, 3, False), ("r", "temp", "d/a.txt", False, 1, 10, False), ("r", "temp", "gone.tmp", False, 1, 1, False), ("r", "empty-dir", "d/e", True, 0, 0, False), ("r", "stale", "Out/Name.txt", False, 1, 1, True)]
    findings, seen = spark.createDataFrame(found, kinds), spark.createDataFrame(TREE, SEEN)
    needs = spark.createDataFrame([("r", "d/b (1).txt", "d/b.txt", 3, 8)], "root string, relpath string, requires string, requires_size long, requires_mtime_ns long")
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(C.build(findings, seen, requires=needs)) == ["d/a.txt", "d/b (1).txt", "d/e"]
    assert names(C.build(findings, seen, requires=needs, reviews=True, categories=["stale"])) == ["Out/Name.txt"]
    later = spark.createDataFrame([("r", "d/b.txt", False, 5, 4, 8) if r[1] == "d/b.txt" else ("r", "d/a.txt", False, 2, 10, 70) if r[1] == "d/a.txt" else r for r in TREE], SEEN)
    assert names(C.build(findings, seen, requires=needs, now=later, others=spark.createDataFrame([("r", "d/e/x")], "root string, relpath string"))) == []
    built = C.build(findings, seen, requires=needs)
    assert all(r.problem is None for r in C.check(built, seen).collect())


def replay(records):
    """State and pending paths, one record after the other."""
    applied = finished = restored = purged = False
    acts, moved = 0, {}
    for _, event, path, size in records:
        if event == "apply":
            applied, finished, acts = True, False, 0
        elif event in ("quarantine", "move"):
            acts += 1
            moved[path] = (event, size)
        elif event == "abort" and acts == 0:
            applied = False
        elif event == "finish":
            finished = True
        elif event in ("restore", "purge"):
            restored, purged = restored or event == "restore", purged or event == "purge"
            moved.pop(path, None)
    state = "draft" if not applied else "interrupted" if not finished else "purged" if purged and not moved else ("partially-undone" if moved else "undone") if restored else "applied"
    return state, list(reversed([(p, *v) for p, v in moved.items()]))


def test_journals_against_a_replay(spark):
    rng, rows = random.Random(4), []
    for plan in range(600):
        for seq in range(rng.randrange(1, 14)):
            rows.append((f"p{plan}", seq * 2, rng.choice(["apply", "apply", "quarantine", "quarantine", "move", "finish", "finish", "abort", "restore", "purge", "detached"]), rng.choice("ab"), rng.randrange(9)))
    journal = spark.createDataFrame(rows, "plan_id string, seq long, event string, path string, size long").repartition(3)
    want = {p: replay([r[1:] for r in rows if r[0] == p]) for p in {r[0] for r in rows}}
    got = {r.plan_id: (r.state, r.pending, r.pending_size) for r in C.journal_state(journal).collect()}
    assert got == {p: (s, len(m), sum(x[2] for x in m)) for p, (s, m) in want.items()}
    assert {s for s, _ in want.values()} == {"draft", "interrupted", "purged", "undone", "partially-undone", "applied"}
    undo = {}
    for r in C.pending_restores(journal).orderBy("undo").collect():
        undo.setdefault(r.plan_id, []).append((r.path, r.event, r.size))
    assert undo == {p: m for p, (_, m) in want.items() if m}


def test_sync_paused(spark):
    rows = [("a", 1, "sync-pause", None), ("b", 1, "sync-pause", None), ("b", 2, "sync-error", "full"), ("c", 1, "sync-error", "x"), ("d", 1, "sync-pause", None), ("d", 2, "sync-resume", None), ("e", 1, "sync-error", "old"), ("e", 2, "sync-pause", None)]
    got = C.sync_paused(spark.createDataFrame(rows, "plan_id string, seq long, event string, detail string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", ""), ("b", "full"), ("e", "")]


def test_unsafe_paths_and_batches(spark):
    rows = [("a", "/x"), ("a", "b//c"), ("a", "b/../c"), ("a", "./c"), ("a", "a"), ("a", "a/b"), ("a", "ab"), ("a/b", "a")]
    got = spark.createDataFrame(rows, "path string, dest string")
    assert [r[0] for r in got.select(C.path_problem(got.path, got.dest)).collect()] == ["absolute", "bad part", "bad part", "bad part", "into itself", "into itself", None, None]
    moves = spark.createDataFrame([("r", "a", "x/a"), ("r", "a/b", "y"), ("r", "c", "X/A"), ("r", "e", "e"), ("q", "z", "x/a")], "root string, path string, dest string")
    assert sorted((r.path, r.clash) for r in C.normalized_batch(moves).collect()) == [("a", True), ("c", True), ("z", False)]
