import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from treeledger.functions import names as N
from treeledger.functions import paths as P
from treeledger.operators import inventory as I
from treeledger.operators import meta as M
from treeledger.queries import QUERIES, SQL
from treeledger.sources import logs
from treeledger.streaming import monitors

SF = "/root/testdata/sf0.001"
TABLES = "documents events lineitem conversations benchmark labels".split()


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["hygiene_findings", "subtree_sizes", "duplicates", "search_text_indexed", "inventory_diff", "inventory_moves", "tags_folded", "effective_attributes", "plan_check", "journal_state", "sync_progress", "folder_types"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.sql(SQL[name])
    order = sorted(r.columns)
    want = sorted((tuple(rounded(x[r.columns.index(k)]) for k in order) for x in r.fetchall()), key=str)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == order
    assert sorted((tuple(rounded(x[k]) for k in order) for x in df.collect()), key=str) == want


@pytest.mark.parametrize(
    "path,size,want",
    [("m/~$minutes.docx", 9, "office-lock"), ("m/Ehthumbs.db", 9, "os-junk"), ("disk9.qcow2", 9, "vm-image"), ("kit/setup-77.exe", 9, "installer"), ("Downloads/tool.exe", 9, "installer"), ("tool.exe", 9, None), ("half.part", 9, "temp"), ("minutes (12).odt", 9, "conflict"), ("log.txt.conflict7", 9, "conflict"), ("memo[Conflicted] old.md", 9, "conflict"), ("budget-kestrel9.ods", 9, "conflict"), ("nil.csv", 0, "empty-file"), ("nil.csv", 9, None)],
)
def test_names(spark, path, size, want):
    df = spark.createDataFrame([(path, size)], "p string, s long")
    assert df.select(N.classify_file(F.col("p"), F.col("s"), ["kestrel9"])).first()[0] == want


def test_conflict_originals(spark):
    df = spark.createDataFrame([("minutes (12).odt",), ("log.txt.conflict7",), ("budget-kestrel9.ods",), ("clean.txt",), ("sheet-kestrel9-safeBackup-0042.one",)], "p string")
    got = [r[0] for r in df.select(N.conflict_original(F.col("p"), ["kestrel9"])).collect()]
    assert got == ["minutes.odt", "log.txt", "budget.ods", None, "sheet.one"]


def test_paths(spark):
    r = spark.createDataFrame([("a/b/.x.tar.gz",)], "p string").select(P.ancestors(F.col("p")), P.parent(F.col("p")), P.extension(F.col("p")), P.hidden(F.col("p"))).first()
    assert list(r) == [["", "a", "a/b"], "a/b", ".gz", True]


def sequential(events):
    state = {}
    for e in sorted(events, key=lambda x: x[0]):
        _, op, path, tag, src, dst = e
        if op == "add":
            state[(path, tag)] = True
        elif op == "remove":
            state.pop((path, tag), None)
        else:
            moved = {k: v for k, v in state.items() if k[0] == src or k[0].startswith(src + "/")}
            for k in moved:
                state.pop(k)
            for (p, t), v in moved.items():
                state[(dst + p[len(src) :], t)] = v
    return set(state)


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_sequential_fold(spark, seed):
    rng = random.Random(seed)
    paths = ["a", "a/x", "b", "b/x", "c", "c/y"]
    events = []
    for i in range(80):
        if rng.random() < 0.2:
            src, dst = rng.sample(["a", "b", "c"], 2)
            events.append((i, "move", None, None, src, dst))
        else:
            events.append((i, rng.choice(["add", "add", "remove"]), rng.choice(paths), rng.choice("tu"), None, None))
    df = spark.createDataFrame([("r", *e) for e in events], "root string, seq long, op string, path string, tag string, src string, dst string")
    assert {(r.path, r.tag) for r in M.fold_tags(df).collect()} == sequential(events)


def test_moves_and_lineage(spark):
    live = spark.createDataFrame([("r", "d", True, 0, 1, 5), ("r", "d/f", False, 3, 1, 6), ("r", "x", False, 1, 1, 7)], "root string, relpath string, is_dir boolean, size long, mtime_ns long, inode long")
    seen = spark.createDataFrame([("r", "e", True, 0, 1, 5), ("r", "e/f", False, 3, 1, 6), ("r", "x", False, 2, 1, 7)], live.schema)
    changes = I.diff(live, seen)
    assert [(m.old_relpath, m.new_relpath) for m in I.inode_moves(changes).collect()] == [("d", "e")]
    moves = spark.createDataFrame([("r", 1, "a", "b", 10), ("r", 2, "old", "new", 20)], "root string, move_id long, old_relpath string, new_relpath string, moved_at long")
    path = spark.createDataFrame([("r", "new/z")], "root string, relpath string")
    assert {(s.relpath, s.since, s.until) for s in I.lineage(moves, path).collect()} == {("new/z", 20, None), ("old/z", None, 20)}


def test_relink(spark):
    old = spark.createDataFrame([("r", "a.pdf", "h1", 5, 1), ("r", "p/n.txt", "h2", 5, 1), ("r", "q/m.txt", "h2", 5, 1)], "root string, relpath string, sha256 string, size long, last_seen long")
    new = spark.createDataFrame([("r", "docs/b.pdf", "h1", 5, 2), ("r", "s/n.txt", "h2", 5, 2), ("r", "s/k.txt", "h2", 5, 2)], "root string, relpath string, sha256 string, size long, first_seen long")
    assert {(x.old_relpath, x.new_relpath, x.rule) for x in I.relink(old, new).collect()} == {("a.pdf", "docs/b.pdf", "content"), ("p/n.txt", "s/n.txt", "name")}


def test_log_source_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "h1.jsonl").write_text('{"at":"2","op":"add","root":"r","path":"p","tag":"t"}\nbroken\n\n{"at":"1","op":"remove","root":"r","path":"p","tag":"t"}\n')
    (log / "h2.jsonl").write_text('{"op":"add","root":"r","path":"q","tag":"t"}\n')
    assert [(r.seq, r.op, r.path) for r in logs.read(spark, str(log)).orderBy("seq").collect()] == [(1, "add", "q"), (2, "remove", "p"), (3, "add", "p")]
    lines = [("e", 1, "a: Copied"), ("e", 2, "run started"), ("e", 3, "b: Copied"), ("e", 4, "ERROR : x"), ("e", 5, "c: Deleted")]
    df = spark.createDataFrame(lines, "entry string, line_no long, line string")
    want = [("e", 1, 1, 1, 1, "c")]
    assert [tuple(r) for r in monitors.progress(df).collect()] == want
    src = str(tmp_path / "in")
    df.coalesce(1).write.json(src)
    q = monitors.progress_stream(spark.readStream.schema(df.schema).json(src)).writeStream.outputMode("update").format("memory").queryName("prog").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from prog").collect()] == want


def test_data_is_there():
    assert os.path.isdir(SF)
