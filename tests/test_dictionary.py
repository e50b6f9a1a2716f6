"""Aliases, parents and the order of moves against plain Python."""

import random

from treeledger.operators import dictionary as D

PAIRS, ALIASES = "seq long, tag string, parent string", "alias string, tag string"


def follow(aliases, tag):
    seen = []
    while tag in aliases and tag not in seen and len(seen) < 32:
        seen.append(tag)
        tag = aliases[tag]
    return tag


def test_alias_chains(spark):
    held = {f"a{i}": f"a{i + 1}" for i in range(31)} | {f"b{i}": f"b{i + 1}" for i in range(33)} | {f"c{i}": f"c{i + 1}" for i in range(90)}
    held |= {"x": "r0", "r0": "r1", "r1": "r2", "r2": "r0", "self": "other"} | {f"q{i}": f"q{(i + 1) % 40}" for i in range(40)} | {"y": "q7"}
    got = {r.alias: r.tag for r in D.canonical_names(spark.createDataFrame(list(held.items()), ALIASES).repartition(3)).collect()}
    assert got == {a: follow(held, a) for a in held}


def test_add_aliases(spark):
    items = spark.createDataFrame([("used",)], "tag string")
    aliases = spark.createDataFrame([("old", "name")], ALIASES)
    parents = spark.createDataFrame([("kid", "top")], "tag string, parent string")
    asked = [(1, "name", "new"), (2, "name2", "used"), (3, "top2", "kid"), (4, "old", "name"), (5, "fresh", "fresh"), (6, "used", "w"), (7, "zz", "old")]
    got = {r.seq: (r.outcome, r.src, r.dst) for r in D.add_aliases(spark.createDataFrame(asked, "seq long, tag string, alias string"), items, aliases, parents).collect()}
    assert got == {1: ("alias", "new", "name"), 2: ("rename", "used", "name2"), 3: ("rename", "kid", "top2"), 4: ("later", "name", "name"), 5: ("refused", "fresh", "fresh"), 6: ("later", "w", "used"), 7: ("later", "old", "zz")}


def test_parents_one_after_the_other(spark):
    rng = random.Random(8)
    tags = [f"t{i}" for i in range(7)]
    known = {("t0", "t1"), ("t1", "t2")}
    aliases = {"al": "t3"}
    asked = [(i, rng.choice([*tags, "al"]), rng.choice(tags)) for i in range(14)]
    held, want = set(known), {}

    def reaches(a, b):
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            for c, p in held:
                if c == x and p not in seen:
                    seen.add(p)
                    todo.append(p)
        return b in seen

    for seq, tag, parent in asked:
        tag, parent = follow(aliases, tag), follow(aliases, parent)
        if tag == parent or reaches(parent, tag):
            want[seq] = "refused"
        else:
            want[seq] = "known" if (tag, parent) in held else "added"
            held.add((tag, parent))
    got = D.add_parents(spark.createDataFrame(asked, PAIRS), spark.createDataFrame(list(known), "tag string, parent string"), spark.createDataFrame(list(aliases.items()), ALIASES))
    assert {r.seq: r.outcome for r in got.collect()} == want and {"refused", "known", "added"} == set(want.values())


def test_dictionary_listing(spark):
    got = D.dictionary(spark.createDataFrame([("i",)], "tag string"), spark.createDataFrame([("b", "i"), ("a", "i"), ("z", "only")], ALIASES), spark.createDataFrame([("i", "p"), ("k", "p")], "tag string, parent string"))
    assert {r.tag: (r.aliases, r.parents, r.children) for r in got.collect()} == {"i": (["a", "b"], ["p"], []), "only": (["z"], [], []), "p": ([], [], ["i", "k"]), "k": ([], ["p"], [])}


def under(path, base):
    return path == base or path.startswith(base + "/")


def test_order_of_moves(spark):
    chains = [(f"s{i}", f"s{i + 1}") for i in range(5)]
    held = [*chains, ("a", "b"), ("b", "a"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("p", "q"), ("p/x", "q/y"), ("p/x/1", "z/1"), ("c", "p"), ("waits", "a/in")]
    rows = D.ordered_moves(spark.createDataFrame([("r", *m) for m in [*held, held[0]]], "root string, src string, dst string")).orderBy("place").collect()
    order = [(r.src, r.dst) for r in rows]
    assert sorted(order) == sorted(held)
    ring = {("a", "b"), ("b", "a"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("waits", "a/in")}
    assert {(r.src, r.dst) for r in rows if r.cyclic} == ring and all(r.cyclic for r in rows[-len(ring) :])
    free = [m for m in order if m not in ring]
    for i, (s, d) in enumerate(free):
        for s2, _ in free[i + 1 :]:  # a later move may not be one that has to come before
            assert not (s2 != s and under(s2, s)) and not under(d, s2)
    # one after the other gives what all at once would give: the deepest source above a path decides
    start = ["s0/f", "s3/f", "p/f", "p/x/f", "p/x/1/f", "c/f", "other"]
    now = list(start)
    for s, d in free:
        now = [d + p[len(s) :] if under(p, s) else p for p in now]
    once = []
    for p in start:
        best = max((m for m in free if under(p, m[0])), key=lambda m: len(m[0]), default=None)
        once.append(best[1] + p[len(best[0]) :] if best else p)
    assert now == once


def test_moves_that_touch_metadata(spark):
    moves = spark.createDataFrame([("r", "a", "b"), ("r", "a/x", "c"), ("r", "n", "m"), ("q", "a", "b")], "root string, src string, dst string")
    got = D.touching(moves, spark.createDataFrame([("r", "a/x/y")], "root string, path string"))
    assert sorted((r.root, r.src) for r in got.collect()) == [("r", "a"), ("r", "a/x")]
