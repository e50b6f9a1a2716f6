"""Streams that are stopped and started again, against their batch forms; the log source over many splits."""

import json


from treeledger.sources import logs as L
from treeledger.streaming import live as S


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(start, *args, **more):
    query = start(*args, **more)
    query.awaitTermination()
    assert query.exception() is None


def again(spark, checkpoint):
    """As if the last batch had failed after its work: its commit is lost, so it runs once more."""
    commits = sorted((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last = commits[-1]
    last.rename(last.with_name(f"lost{last.name}"))
    for crc in (checkpoint / "commits").glob(f".{last.name}.crc"):
        crc.rename(crc.with_name("lost.crc"))


def test_late_events_and_a_repeated_batch(spark, tmp_path):
    log, out, mark = tmp_path / "log", str(tmp_path / "out"), tmp_path / "mark"
    start = lambda: run(S.live_facts, spark.readStream.schema(S.EVENTS).json(str(log)), out, str(mark))
    facts = lambda: sorted((r.root, r.path, r.tag) for r in S.live_state(spark, out).collect())
    put(log, "a", [{"at": "2", "file": "h1", "line": 0, "op": "add", "root": "r", "path": "x/f", "tag": "t"}, {"at": "2", "file": "h1", "line": 1, "op": "add", "root": "q", "path": "y", "tag": "u"}])
    start()
    assert facts() == [("q", "y", "u"), ("r", "x/f", "t")]
    # a late move that another writer made before the tag was set doesn't carry it, a later one does
    put(log, "b", [{"at": "1", "file": "h2", "line": 0, "op": "move", "root": "r", "src": "x", "dst": "old"}, {"at": "3", "file": "h2", "line": 1, "op": "move", "root": "r", "src": "x", "dst": "new"}])
    start()
    assert facts() == [("q", "y", "u"), ("r", "new/f", "t")]
    again(spark, mark)
    start()
    assert facts() == [("q", "y", "u"), ("r", "new/f", "t")]
    put(log, "c", [{"at": "4", "file": "h1", "line": 2, "op": "rename", "src": "t", "dst": "t2"}, {"at": "5", "file": "h1", "line": 3, "op": "remove", "root": "q", "path": "y", "tag": "u"}])
    start()
    assert facts() == [("r", "new/f", "t2")]


def test_reflected_deletions(spark, tmp_path):
    lines = [("r", "2026/01/01 INFO  : a/b.txt: Deleted"), ("r", "Deleting item from Microsoft OneDrive: ./c d.txt "), ("r", "INFO  : other: Deleted"), ("r", "INFO  : a/b.txt: Deleted"), ("q", "INFO  : a/b.txt: Copied (new)")]
    expected = spark.createDataFrame([("r", "a/b.txt"), ("r", "c d.txt"), ("r", "left"), ("q", "a/b.txt")], "root string, path string")
    frame = spark.createDataFrame(lines, "root string, line string")
    want = [("r", "a/b.txt"), ("r", "c d.txt")]
    assert sorted(map(tuple, S.reflected(frame, expected).collect())) == want
    assert sorted(map(tuple, S.still_expected(frame, expected).collect())) == [("q", "a/b.txt"), ("r", "left")]
    folder = tmp_path / "in"
    seen = []
    for i, part in enumerate((lines[:2], lines[2:])):
        put(folder, f"f{i}", [{"root": r, "line": x} for r, x in part])
        stream = S.reflected(spark.readStream.schema("root string, line string").json(str(folder)), expected)
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(seen) == want


def test_a_half_written_line_waits(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    for i, text in enumerate(("first\nINFO  : a/b.t", "xt: Deleted\r\nlast has no", " end")):
        put(folder, f"f{i}", [{"root": "r", "chunk": i, "text": text}])
        stream = S.whole_lines(spark.readStream.schema("root string, chunk long, text string").json(str(folder)))
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(seen) == [("r", 0, "first"), ("r", 1, "INFO  : a/b.txt: Deleted")]


def listing(scan, paths, root="r"):
    return [{"scan": scan, "root": root, "relpath": p, "is_dir": False, "size": 1, "mtime_ns": 1, "inode": i} for p, i in paths]


def test_held_scans(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark"
    schema = "scan long, root string, relpath string, is_dir boolean, size long, mtime_ns long, inode long"
    start = lambda accept=frozenset(): run(S.live_catalog, spark.readStream.schema(schema).json(str(folder)), out, str(mark), 1, 0.2, accept)
    state = lambda: {r.relpath: (r.missing_count, r.gone_at) for r in S.Versions(spark, out, S.ENTRIES).before().collect() if r.root == "r"}
    full = [(f"f{i}", i) for i in range(10)]
    put(folder, "a", listing(1, full) + listing(1, [("z", 99)], "q"))
    start()
    put(folder, "b", listing(2, full[:5]))  # five of ten are lost: held
    start()
    assert state() == {f"f{i}": (0 if i < 5 else 1, None) for i in range(10)}
    put(folder, "c", listing(3, [*full[2:6], ("moved", 1)]))  # f5 is back, f1 moved, f0 is missing for the first time
    start()
    assert {p: g for p, (_, g) in state().items() if g} == {f"f{i}": 3 for i in range(6, 10)}
    assert state()["f0"] == (1, None) and state()["f5"] == (0, None) and "f1" not in state() and state()["moved"] == (0, None)
    before = state()
    again(spark, mark)
    start()
    assert state() == before
    put(folder, "d", listing(4, [("f2", 2)]))
    start(frozenset({4}))  # accepted: all that is missing goes at once
    assert {p for p, (_, g) in state().items() if g is None} == {"f2"}
    assert [r.relpath for r in S.Versions(spark, out, S.ENTRIES).before().filter("root = 'q' AND gone_at IS NULL").collect()] == ["z"]


def test_snapshot_alerts(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), tmp_path / "mark"
    rows = lambda taken, n: [{"root": "r", "taken_at": taken, "relpath": f"f{i}", "size": 1, "mtime_ns": 1} for i in range(n)]
    start = lambda dismissed=None: run(S.watched_snapshots, spark.readStream.schema(S.FILES).json(str(folder)), out, str(mark), dismissed)
    alerts = lambda: sorted(r.newer for r in S.Versions(spark, f"{out}/alerts", S.ALERTS).before().collect())
    put(folder, "s0", rows(100, 2000))
    start()
    put(folder, "s1", rows(101, 1000))
    start()
    assert alerts() == [101]
    again(spark, mark)
    start()
    assert alerts() == [101]
    put(folder, "s2", [x for k in range(24) for x in rows(102 + k, 2000 if k % 2 == 0 else 900)])
    start()
    assert alerts() == [101, *range(103, 126, 2)]
    start(spark.createDataFrame([("r", 101)], "root string, newer long"))
    put(folder, "s3", rows(130, 900))
    start(spark.createDataFrame([("r", 101)], "root string, newer long"))
    assert alerts() == [*range(103, 126, 2)]


def test_a_log_is_read_by_many_tasks(spark, tmp_path):
    texts = [json.dumps({"at": f"{i % 7}", "op": "add", "root": f"r{i % 3}", "path": f"p{i}", "n": i}) for i in range(400)]
    texts[10], texts[20], texts[30] = "", "{broken", '["no object"]'
    texts[40] = json.dumps({"root": "r", "path": "without op", "at": "0", "n": 40})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(texts) + "\n" + '{"op": "add", "path": "half')
    (tmp_path / "log" / "b.jsonl").write_text(json.dumps({"op": "add", "root": "r9", "path": "first", "n": -1}) + "\r\n")
    held = [(json.loads(t), i) for i, t in enumerate(texts) if i not in (10, 20, 30)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "log")).rdd.getNumPartitions() > 5
        numbers = {(r.file, r.line) for r in L.lines(spark, str(tmp_path / "log")).collect()}
        assert numbers == {("a.jsonl", i) for i in range(401) if i != 10} | {("b.jsonl", 0)}
        got = L.read(spark, str(tmp_path / "log"), "at string, op string, root string, path string, n long").orderBy("seq").collect()
        every = L.read(spark, str(tmp_path / "log"), "at string, path string, n long", required=None).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [-1, *[e["n"] for e, _ in sorted((x for x in held if "op" in x[0]), key=lambda x: (x[0]["at"], x[1]))]]
    assert [r.n for r in got] == want and [r.seq for r in got] == list(range(1, len(want) + 1))
    assert sorted(r.n for r in every) == sorted([-1, *[e["n"] for e, _ in held]])


def test_latest_extracts(spark):
    rows = spark.createDataFrame([("s", "ocr", 1), ("s", "text", 2), ("t", "none", 1), ("t", "a", 1)], "sha256 string, method string, created_at long")
    assert sorted((r.sha256, r.method) for r in L.latest_extracts(rows).select(*rows.columns).collect()) == [("s", "text"), ("t", "a")]
