"""The fold of all events against a sequential one in plain Python."""

import random
import time

import pytest

from treeledger.operators import fold as G
from treeledger.operators import moves as V

SCHEMA = ", ".join(f"{c} {t}" for c, t in G.COLUMNS.items())
SIMPLE = ("attrs", "kept", "types", "cards", "reviews")


def under(path, base):
    return path == base or path.startswith(base + "/")


def sequential(log):
    """One event after the other, over dictionaries."""
    s = {k: {} for k in ("items", "relations", "no_extract", "relink_skips", "aliases", "parents", "attr_defs", "searches", *SIMPLE)}

    def name(tag):
        seen = []
        while tag in s["aliases"] and tag not in seen and len(seen) < 32:
            seen.append(tag)
            tag = s["aliases"][tag]
        return tag

    def put(table, key, value, on):
        if on:
            s[table][key] = value
        else:
            s[table].pop(key, None)

    def retag(old, new):
        for root, path, tag in [k for k in s["items"] if k[2] == old]:
            del s["items"][root, path, tag]
            if new is not None:
                s["items"][root, path, new] = True

    for e in sorted(log, key=lambda e: e["seq"]):
        op, root, path, g = e["op"], e.get("root"), e.get("path"), e.get
        if op in ("add", "remove"):
            put("items", (root, path, name(e["tag"])), True, op == "add")
        elif op == "rename":
            retag(e["src"], e["dst"])
            s["aliases"] = {a: e["dst"] if c == e["src"] else c for a, c in s["aliases"].items()}
            new = {}
            for c, p in s["parents"]:
                c2, p2 = (e["dst"] if x == e["src"] else x for x in (c, p))
                if c2 != p2:
                    new[c2, p2] = True
            s["parents"] = new
        elif op == "delete":
            retag(e["tag"], None)
            s["aliases"] = {a: c for a, c in s["aliases"].items() if c != e["tag"]}
            s["parents"] = {k: True for k in s["parents"] if e["tag"] not in k}
        elif op == "alias" and e["alias"] != e["tag"]:
            s["aliases"][e["alias"]] = e["tag"]
            if name(e["tag"]) != e["alias"]:
                retag(e["alias"], name(e["tag"]))
        elif op == "unalias":
            s["aliases"].pop(e["alias"], None)
        elif op in ("parent", "unparent") and e["tag"] != e["parent"]:
            put("parents", (e["tag"], e["parent"]), True, op == "parent")
        elif op == "move":
            to = lambda p: e["dst"] + p[len(e["src"]) :] if under(p, e["src"]) else p
            for table in ("items", "no_extract", "relink_skips", *SIMPLE):
                moved = {k: v for k, v in s[table].items() if k[0] == root and under(k[1], e["src"])}
                for k in moved:
                    del s[table][k]
                for k, v in moved.items():
                    s[table][k[0], to(k[1]), *k[2:]] = v
            s["relations"] = {(r, to(a), to(b), k) if r == root else (r, a, b, k): True for r, a, b, k in s["relations"]}
        elif op in ("attr-set", "attr-unset"):
            put("attrs", (root, path, e["name"]), g("value"), op == "attr-set")
        elif op in ("attr-def", "attr-undef"):
            put("attr_defs", (e["name"],), (g("type"), None), op == "attr-def")
            if op == "attr-undef":
                s["attrs"] = {k: v for k, v in s["attrs"].items() if k[2] != e["name"]}
        elif op in ("relate", "unrelate"):
            if op == "unrelate" or e["src"] != e["dst"]:
                put("relations", (root, e["src"], e["dst"], g("kind") or G.RELATED), True, op == "relate")
        elif op in ("keep", "unkeep"):
            put("kept", (root, path), g("reason") or "", op == "keep")
        elif op == "dir-type":
            put("types", (root, path), g("type"), g("type"))
        elif op == "dir-card":
            card = (g("description") or "", g("naming") or "")
            put("cards", (root, path), card, any(card))
        elif op == "dir-extract":
            put("no_extract", (root, path), True, g("extract") is False)
        elif op == "review":
            s["reviews"][root, path, g("sha256") or ""] = g("decision") or ""
        elif op == "relink-skip":
            s["relink_skips"][root, path, g("sha256") or ""] = True
        elif op in ("search-save", "search-delete"):
            put("searches", (e["name"],), (g("query"),), op == "search-save")
    rows = lambda t: {(k if isinstance(k, tuple) else (k,)) + (() if v is True else v if isinstance(v, tuple) else (v,)) for k, v in s[t].items()}
    return {t: rows(t) for t in s}


def state(spark, log):
    frame = spark.createDataFrame([tuple(e.get(c) for c in G.COLUMNS) for e in log], SCHEMA)
    out = {}
    for table, df in G.fold(frame.repartition(3)).items():
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)), table
        out[table] = set(got)
    return out


def random_log(seed, n=400):
    rng = random.Random(seed)
    names, tags = "abc", ["t1", "t2", "t3", "t4"]
    path = lambda: "/".join(rng.choice(names) for _ in range(rng.choice([1, 1, 2, 2, 3])))
    log = []
    for seq in range(n):
        e = {"seq": seq * 3, "root": rng.choice(["r", "r", "q"]), "path": path(), "tag": rng.choice(tags)}
        e["op"] = op = rng.choice(
            ["add"] * 8 + ["remove"] * 5 + ["move"] * 9 + ["attr-set"] * 3 + ["attr-unset"] * 2 + ["relate"] * 4 + ["unrelate"] * 4 + ["keep", "unkeep", "dir-type", "dir-type", "dir-card", "dir-extract", "dir-extract", "review", "relink-skip"]
            + ["rename", "rename", "delete", "alias", "alias", "unalias", "parent", "parent", "unparent", "attr-def", "attr-undef", "search-save", "search-delete", "unknown"]
        )
        e |= {"name": rng.choice(["n1", "n2"]), "value": rng.choice(["x", "y", None]), "kind": rng.choice([None, "", "k"]), "sha256": rng.choice([None, "s"]), "decision": rng.choice(["accept", "reject"])}
        e |= {"reason": rng.choice([None, f"why{seq}"]), "type": rng.choice(["", "inbox", "app", None]), "description": rng.choice([None, f"d{seq}"]), "naming": rng.choice([None, "f"]), "extract": rng.choice([False, False, True, None]), "query": f"q{seq}"}
        if op == "move":
            e["src"], e["dst"] = path(), path()
            while under(e["dst"], e["src"]):
                e["dst"] = path()
        elif op == "rename":
            e["src"], e["dst"] = rng.sample(tags, 2)
        elif op in ("relate", "unrelate"):
            e["src"], e["dst"] = path(), path()
        elif op in ("alias", "unalias"):
            e["alias"] = rng.choice(tags)
        elif op in ("parent", "unparent"):
            e["parent"] = rng.choice(tags)
        if op == "attr-def":
            e["type"] = e["type"] or "text"
        log.append(e)
    return log


@pytest.mark.parametrize("seed", range(1))
def test_random_logs(spark, seed):
    log = random_log(seed)
    got, want = state(spark, log), sequential(log)
    for table in want:
        assert got[table] == want[table], table


def test_a_thousand_chained_moves(spark):
    log = [{"seq": 0, "op": "add", "root": "r", "path": "d0/f", "tag": "t"}, {"seq": 1, "op": "keep", "root": "r", "path": "d0", "reason": "x"}]
    log += [{"seq": 2 + i, "op": "move", "root": "r", "src": f"d{i}", "dst": f"d{i + 1}"} for i in range(1000)]
    frame = spark.createDataFrame([tuple(e.get(c) for c in G.COLUMNS) for e in log], SCHEMA)
    began = time.time()
    e = V.cut(G.whole(frame))
    moves = V.cut(e.filter("op = 'move'").select("root", V.F.col("seq").alias("m"), "src", "dst"))
    trees = V.forest(moves)
    rows = e.filter("op <> 'move'").select(V.F.col("seq").alias("id"), "root", "path", V.F.col("seq").alias("arrived"))
    _, ends = V.segments(V.next_moves(rows, moves, "path", "arrived", ["id"]), trees)
    assert sorted((r.id, r.path) for r in ends.collect()) == [(0, "d1000/f"), (1, "d1000")]
    assert time.time() - began < 60


def test_log_without_moves_and_renames(spark):
    log = [e for e in random_log(9, 300) if e["op"] not in ("move", "rename", "alias", "delete")]
    got, want = state(spark, log), sequential(log)
    for table in want:
        assert got[table] == want[table], table


def test_empty_log(spark):
    assert all(not rows for rows in state(spark, []).values())
