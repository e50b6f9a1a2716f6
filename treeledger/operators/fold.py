"""The state that stands after a log of metadata events, all kinds of events in one order of ``seq``.

A fact is re-keyed on two axes: its path by moves, its tag by renames, aliases
and deletions. Both axes are resolved apart (``moves``, ``tag_events``); an
event that removes something ends the facts that stood in the same place, under
the same tag, at its time. Nothing is replayed: rounds grow with the logarithm
of the number of chained moves and with the depth of paths.

Events: seq, op, root, path, tag, src, dst (of move, rename, relate and
unrelate), alias, parent, name, type, choices, value, kind, query, sha256,
decision, reason, description, naming, extract. Columns that a log lacks count
as null. ``seq`` has to tell events apart. Paths are taken as they are; a log
source normalises them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import moves as V

COLUMNS = {
    "seq": "long", "op": "string", "root": "string", "path": "string", "tag": "string", "src": "string", "dst": "string", "alias": "string", "parent": "string",
    "name": "string", "type": "string", "choices": "array<string>", "value": "string", "kind": "string", "query": "string", "sha256": "string", "decision": "string",
    "reason": "string", "description": "string", "naming": "string", "extract": "boolean",
}
#: Hops from alias to name at most: a bound against cycles.
HOPS = 32
#: The kind of a relation that names none (a fixed value).
RELATED = "関連"


def whole(events: DataFrame) -> DataFrame:
    """The events with all columns."""
    return events.select(*[(F.col(c).cast(t) if c in events.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()])


#: Tables of facts that stand at a path, with the kind of fact, and the others.
PLACED = {"items": "item", "attrs": "attr", "relations": "relation", "kept": "kept", "types": "type", "cards": "card", "no_extract": "no_extract", "reviews": "review", "relink_skips": "relink_skip"}
NAMED = ["aliases", "parents", "attr_defs", "searches"]


# --- tags over time ---


def tag_forest(changes: DataFrame) -> DataFrame:
    """(m, src, dst, up): the tag events with the next one of their destination; changes: m, src, dst (null: deleted)."""
    marks = changes.select(F.col("src").alias("tag"), F.col("m").alias("mark"))
    rows = changes.filter("dst IS NOT NULL").select("m", "src", "dst", F.col("dst").alias("tag"))
    held = V.following(rows, marks, ["tag"], "m", "up").select("m", "src", "dst", "up")
    return cut(held.unionByName(changes.filter("dst IS NULL").select("m", "src", "dst", F.lit(None).cast("long").alias("up"))))


def tag_places(forest: DataFrame) -> DataFrame:
    """(n, tag, nx, since): for each tag event n the names that a tag which goes through it has afterwards: name, its next event (null: none), since when.

    The closure of the forest, by doubling. After a deletion there is none.
    """
    pairs = cut(forest.select(F.col("m").alias("n"), F.col("m").alias("c")))
    step = forest.filter("up IS NOT NULL").select(F.col("m").alias("c"), F.col("up").alias("far"))
    while True:
        more = cut(pairs.join(step, "c").select("n", F.col("far").alias("c")))
        if more.isEmpty():
            break
        pairs = cut(pairs.unionByName(more))
        step = cut(step.join(step.select(F.col("c").alias("far"), F.col("far").alias("farther")), "far").select("c", F.col("farther").alias("far")))
    return cut(pairs.join(forest.select(F.col("m").alias("c"), "dst", "up"), "c").filter("dst IS NOT NULL").select("n", F.col("dst").alias("tag"), F.col("up").alias("nx"), F.col("c").alias("since")))


def alias_spans(events: DataFrame) -> DataFrame:
    """(alias, tag, since, until): what an alias stood for, and when (until: null if it still does); renames carry it on, deletions end it."""
    set_ = events.filter("op = 'alias' AND alias <> tag").select(F.col("seq").alias("m"), "alias", "tag")
    ends = events.filter("(op = 'alias' AND alias <> tag) OR op = 'unalias'").select("alias", F.col("seq").alias("mark"))
    set_ = V.following(set_, ends, ["alias"], "m", "stop")
    changes = events.filter("op = 'rename' AND src <> dst").select(F.col("seq").alias("m"), "src", "dst").unionByName(events.filter("op = 'delete'").select(F.col("seq").alias("m"), F.col("tag").alias("src"), F.lit(None).cast("string").alias("dst")))
    places = tag_places(tag_forest(changes))
    first = V.following(set_, changes.select(F.col("src").alias("tag"), F.col("m").alias("mark")), ["tag"], "m", "n")
    later = first.filter("n IS NOT NULL").select("alias", "n", "stop").join(places, "n").select("alias", "tag", "since", F.col("nx").alias("n"), "stop")
    spans = first.select("alias", "tag", F.col("m").alias("since"), "n", "stop").unionByName(later).filter("stop IS NULL OR since < stop")
    return cut(spans.select("alias", "tag", "since", F.least(F.coalesce("n", "stop"), F.coalesce("stop", "n")).alias("until")))


def canonical(rows: DataFrame, spans: DataFrame | None, tag: str, at: Column, ident: str) -> DataFrame:
    """``rows`` with ``tag`` replaced by the name that it was an alias of at time ``at``, hop by hop.

    At most ``HOPS`` hops; a name that was passed before ends the chain. Only
    rows that still stand at an alias take part in the next hop.
    """
    if spans is None:
        return rows
    now = rows.select(ident, F.col(tag).alias("__tag"), at.alias("__at"), F.array(F.col(tag)).alias("__seen"))
    done = []
    for _ in range(HOPS):
        s = spans.select(F.col("alias").alias("__tag"), F.col("tag").alias("__to"), "since", "until")
        hop = now.join(s, "__tag").filter((F.col("since") < F.col("__at")) & (F.col("until").isNull() | (F.col("__at") <= F.col("until"))))
        hop = cut(hop.select(ident, F.col("__to").alias("__tag"), "__at", "__seen"))
        if hop.isEmpty():
            break
        done.append(hop.select(ident, "__tag", F.size("__seen").alias("__n")))
        now = hop.filter(~F.array_contains("__seen", F.col("__tag"))).withColumn("__seen", F.array_append("__seen", F.col("__tag")))
    if not done:
        return rows
    last = reduce(DataFrame.unionByName, done).groupBy(ident).agg(F.max_by("__tag", "__n").alias("__tag"))
    return rows.join(last, ident, "left").withColumn(tag, F.coalesce("__tag", F.col(tag))).drop("__tag")


def tag_changes(events: DataFrame, spans: DataFrame | None) -> DataFrame:
    """(m, src, dst): renames, deletions (dst null) and aliases, which rename what bears the alias."""
    renames = events.filter("op = 'rename' AND src <> dst").select(F.col("seq").alias("m"), "src", "dst")
    deletes = events.filter("op = 'delete'").select(F.col("seq").alias("m"), F.col("tag").alias("src"), F.lit(None).cast("string").alias("dst"))
    aliases = canonical(events.filter("op = 'alias' AND alias <> tag").select(F.col("seq").alias("m"), F.col("alias").alias("src"), F.col("tag").alias("dst")), spans, "dst", F.col("m") + F.lit(0.5), "m")
    return cut(renames.unionByName(deletes).unionByName(aliases.filter("src <> dst").select("m", "src", "dst")))


# --- facts ---


def facts(events: DataFrame, spans: DataFrame | None, wanted: set[str]) -> DataFrame:
    """(id, fact, ends, root, path, other, key, value): facts of the ``wanted`` kinds and the events that end them; other: a relation's second path."""
    e = events
    empty, seq = F.lit(None).cast("string"), F.col("seq").alias("id")

    def of(fact: str, start: Column | None, stop: Column | None, key: Column = empty, value: Column = empty, path: Column = F.col("path"), other: Column = empty) -> DataFrame:
        ends = F.when(start, F.lit(False)) if start is not None else F.when(F.lit(False), F.lit(False))
        ends = ends.when(stop, F.lit(True)) if stop is not None else ends
        return e.select(seq, F.lit(fact).alias("fact"), ends.alias("ends"), "root", path.alias("path"), other.alias("other"), key.alias("key"), value.alias("value")).filter("ends IS NOT NULL")

    op = F.col("op")
    items = canonical(of("item", op == "add", op == "remove", F.col("tag")), spans, "key", F.col("id"), "id")
    kind, text = F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.lit(RELATED)), lambda c: F.coalesce(c, F.lit(""))
    card = F.concat_ws("\x1f", text(F.col("description")), text(F.col("naming")))
    typed = text(F.col("type")) != ""
    held = {
        "item": items.select("id", "fact", "ends", "root", "path", "other", "key", "value"),
        "attr": of("attr", op == "attr-set", op == "attr-unset", F.col("name"), F.col("value")),
        "relation": of("relation", (op == "relate") & (F.col("src") != F.col("dst")), op == "unrelate", kind, path=F.col("src"), other=F.col("dst")),
        "kept": of("kept", op == "keep", op == "unkeep", value=text(F.col("reason"))),
        "type": of("type", (op == "dir-type") & typed, (op == "dir-type") & ~typed, value=F.col("type")),
        "card": of("card", (op == "dir-card") & (card != "\x1f"), (op == "dir-card") & (card == "\x1f"), value=card),
        "no_extract": of("no_extract", (op == "dir-extract") & (F.col("extract") == F.lit(False)), (op == "dir-extract") & ~(F.coalesce("extract", F.lit(True)) == F.lit(False))),
        "review": of("review", op == "review", None, text(F.col("sha256")), text(F.col("decision"))),
        "relink_skip": of("relink_skip", op == "relink-skip", None, text(F.col("sha256"))),
    }
    return reduce(DataFrame.unionByName, [df for fact, df in held.items() if fact in wanted])


def reach(stops: DataFrame, trees: DataFrame) -> DataFrame:
    """``stops`` (id, root, e, arrived, pre) with ``hi``: the end of what had come to move e's place when they happened, in the order of e's tree."""
    kids = trees.filter("up IS NOT NULL").select("root", F.col("up").alias("e"), (-F.col("m")).alias("mark"))
    rows = stops.withColumn("back", -F.col("arrived"))
    lone = rows.join(kids.select("root", "e").distinct(), ["root", "e"], "left_anti").select("id", F.col("pre").alias("hi"))
    more = rows.join(kids.select("root", "e").distinct(), ["root", "e"], "left_semi")
    last = V.following(more, kids, ["root", "e"], "back", "kid").select("id", "root", "pre", (-F.col("kid")).alias("m"))
    return lone.unionByName(last.join(trees.select("root", "m", "end"), ["root", "m"], "left").select("id", F.coalesce("end", "pre").alias("hi")))


def _kept(held: DataFrame, moves: DataFrame, changes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The facts and ends that count, with their next move, and their names (id, tag, nx, since), one row for each name that a fact's key takes.

    Of the facts (and of the ends) of one place under one name, with the same
    next move and the same next change of the name, only the last one counts.
    """
    now = V.next_moves(held.withColumn("arrived", F.col("id")), moves, "path", "arrived", ["id"]).withColumn("nx", F.lit(None).cast("long"))
    if changes is not None:
        marks = changes.select(F.col("src").alias("key"), F.col("m").alias("mark"))
        now = now.filter("fact <> 'item'").unionByName(V.following(now.filter("fact = 'item'").drop("nx"), marks, ["key"], "id", "nx"))
    rest = [c for c in (*held.columns, "rest") if c not in ("fact", "ends", "root", "path", "key")]
    place = ["fact", "ends", "root", "path", "key", "n", "nx"]
    now = cut(now.groupBy(*place).agg(F.max_by(F.struct(*rest), "id").alias("last")).select(*place, "last.*"))
    names = now.select("id", F.coalesce("key", F.lit("")).alias("tag"), F.coalesce("nx", F.lit(-1).cast("long")).alias("nx"), F.lit(-1).cast("long").alias("since"))
    if changes is not None:
        later = now.filter("nx IS NOT NULL AND NOT ends").select("id", F.col("nx").alias("n")).join(tag_places(tag_forest(changes)), "n")
        names = cut(names.unionByName(later.select("id", "tag", F.coalesce("nx", F.lit(-1).cast("long")).alias("nx"), "since")))
    return now.drop("nx"), names


def standing(held: DataFrame, moves: DataFrame, trees: DataFrame, changes: DataFrame | None, valued: bool = True) -> DataFrame:
    """The facts (id, fact, root, path, key, value, order) that stand at last, not yet one per place.

    ``changes``: what happens to tags, null if nothing; ``valued``: there are
    facts with values, which need ``order``.

    ``order`` sorts the facts of one place as they came to it: by when they
    came there, then by how those that came together stood before.
    """
    held, names = _kept(held, moves, changes)
    segs, ends = V.segments(held.select("id", "root", "path", F.col("id").alias("arrived"), "n", "rest"), trees)
    held = held.drop("n", "rest")
    kinds = held.select("id", "fact", "ends")
    ended = kinds.filter("ends").select("fact").distinct()
    live = kinds.filter("NOT ends").join(F.broadcast(ended), "fact", "left_semi")
    stops = names.join(kinds.filter("ends"), "id").select("id", "fact", "tag", "nx")
    starts = names.join(live, "id").select("id", "fact", "tag", "nx", "since")
    key = ["root", "fact", "tag", "nx"]
    # a stop's own place is its first segment, or its path if no move comes after it
    own = segs.filter("i = 0").join(stops, "id")
    reached = reach(own.select("id", "root", "e", F.col("id").alias("arrived"), "pre").distinct(), trees)
    own = own.join(reached, "id")
    seg = segs.join(starts, "id")
    # ended in the very place it came to, by the same move's door
    at_door = own.groupBy(*key, "e", "rest").agg(F.max("id").alias("s"))
    gone = [seg.join(at_door, [*key, "e", "rest"]).filter(F.col("s") > F.greatest("arrived", "since")).select("id")]
    # ended after it was carried to a place: intervals of the tree's order, the outermost that reaches this far counts
    frame = [*key, "top", "k", "x"]
    stop_places = own.groupBy(*frame, "pre").agg(F.max(F.struct("hi", F.col("id").alias("s"))).alias("r")).withColumn("pre", F.col("pre") + 1).withColumn("what", F.lit(0))
    both = seg.select(*frame, "pre", "since").distinct().withColumn("what", F.lit(1)).unionByName(stop_places, allowMissingColumns=True)
    outer = F.max("r").over(W.partitionBy(*frame).orderBy("pre", "what").rowsBetween(W.unboundedPreceding, W.currentRow))
    over = both.withColumn("o", outer).filter("what = 1 AND o.hi >= pre AND o.s > since").select(*frame, "pre", "since")
    gone.append(seg.join(over, [*frame, "pre", "since"]).select("id"))
    # ended where it stands now
    final = ends.join(stops, "id").filter("n_segments = 0").groupBy(*key, "path").agg(F.max("id").alias("s"))
    gone.append(ends.join(starts, "id").join(final, [*key, "path"]).filter(F.col("s") > F.greatest("arrived", "since")).select("id"))
    dead = reduce(DataFrame.unionByName, gone).distinct()
    last = names.filter("nx = -1").select("id", "tag")  # a deleted tag has no last name
    out = held.filter("NOT ends").drop("path", "key").join(ends.drop("root", "n_segments"), "id").join(last, "id").join(dead, "id", "left_anti")
    order = F.lit(0)
    if valued:
        came = reach(segs.select(F.concat_ws("/", "id", "i").alias("id"), "root", "e", "arrived", "pre"), trees)
        spot = segs.withColumn("key", F.concat_ws("/", "id", "i")).join(came.withColumnRenamed("id", "key"), "key")
        way = spot.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("i")).alias("i"), "hi", "arrived"))).alias("way"))
        out = out.join(way, "id", "left")
        order = F.struct("arrived", F.coalesce(F.transform("way", lambda w: F.struct(w["hi"], w["arrived"])), F.array()).alias("way"), "id")
    return cut(out.select("id", "fact", "root", "path", "other", F.col("tag").alias("key"), "value", order.alias("order")))


def _relations(held: DataFrame, moves: DataFrame, trees: DataFrame) -> DataFrame:
    """Relations (id, root, src, dst, kind) that stand: both ends are re-keyed, and both have to be where an unrelate names them at its time.

    Only facts and ends that come to one final relation are compared, one for
    each pair of places they were entered at (the latest one of each).
    """
    rel = held.filter("fact = 'relation'").withColumn("key", F.coalesce("key", F.lit("")))
    sides = rel.select(F.concat_ws("/", F.lit("a"), "id").alias("sid"), "root", "path", F.col("id").alias("seq"), "id", F.lit("a").alias("side")).unionByName(
        rel.select(F.concat_ws("/", F.lit("b"), "id").alias("sid"), "root", F.col("other").alias("path"), F.col("id").alias("seq"), "id", F.lit("b").alias("side"))
    )
    sides = cut(sides)
    segs, ends = V.segments(cut(V.next_moves(sides.withColumnRenamed("seq", "arrived"), moves, "path", "arrived", ["sid"])), trees, ("sid",))
    stop_ids = rel.filter("ends").select("id")
    stops = sides.join(stop_ids, "id").select("sid", "id")
    own = segs.filter("i = 0").join(stops, "sid")
    own = own.join(reach(own.select(F.col("sid").alias("id"), "root", "e", F.col("id").alias("arrived"), "pre"), trees).withColumnRenamed("id", "sid"), "sid")
    # per stop and side, the places: a door in a tree, or a path for good
    place = own.select("id", F.substring("sid", 1, 1).alias("side"), F.struct("root", "top", "k", "x", "e", "rest", "pre", "hi").alias("place"))
    final = ends.filter("n_segments = 0").join(stops, "sid").select("id", F.substring("sid", 1, 1).alias("side"), "path")
    stop = rel.filter("ends").select("id", "root", "key")
    goal = ends.withColumn("side", F.substring("sid", 1, 1)).join(sides.select("sid", "id"), "sid")
    both = goal.groupBy("id").agg(F.max(F.when(F.col("side") == "a", F.col("path"))).alias("src"), F.max(F.when(F.col("side") == "b", F.col("path"))).alias("dst"))
    stop = stop.join(both, "id")
    for s in ("a", "b"):
        stop = stop.join(place.filter(F.col("side") == s).select("id", F.col("place").alias(f"p{s}")), "id", "left").join(final.filter(F.col("side") == s).select("id", F.lit(True).alias(f"f{s}")), "id", "left")
    doors = [c for s in ("a", "b") for c in (F.col(f"p{s}.e").alias(f"e{s}"), F.col(f"p{s}.rest").alias(f"r{s}"))]
    stop = stop.groupBy("root", "key", "src", "dst", *doors).agg(F.max_by(F.struct("id", "pa", "pb", "fa", "fb"), "id").alias("s")).select("root", "key", "src", "dst", "s.*").withColumnRenamed("id", "s")
    start = rel.filter("NOT ends").select("id", "root", "key").join(both, "id")
    pairs = cut(start.join(stop, ["root", "key", "src", "dst"]).filter("s > id").select("id", "s", "pa", "pb", "fa", "fb"))
    hit = pairs.select("id", "s")
    for s in ("a", "b"):
        mine = segs.filter(F.substring("sid", 1, 1) == s).select(F.substring("sid", 3, 30).cast("long").alias("id"), "root", "top", "k", "x", "e", "rest", "pre", "arrived")
        p = F.col(f"p{s}")
        inside = (mine["root"] == p["root"]) & (mine["top"] == p["top"]) & (mine["k"] == p["k"]) & (mine["x"] == p["x"]) & (
            ((mine["e"] == p["e"]) & (mine["rest"] == p["rest"]) & (mine["arrived"] < F.col("s"))) | ((mine["pre"] > p["pre"]) & (mine["pre"] <= p["hi"]))
        )
        door = pairs.filter(p.isNotNull()).join(mine, "id").filter(inside).select("id", "s")
        stays = goal.filter(F.col("side") == s).select("id", "arrived")
        ground = pairs.filter(f"f{s}").join(stays, "id").filter("arrived < s").select("id", "s")
        hit = hit.join(door.unionByName(ground).distinct(), ["id", "s"], "left_semi")
    return start.join(hit.select("id").distinct(), "id", "left_anti").select("root", "src", "dst", F.col("key").alias("kind")).distinct()


def _parents(events: DataFrame) -> DataFrame:
    """(tag, parent) that stand: renames carry both sides, deletions end them, and so does a rename of one into the other."""
    changes = cut(events.filter("op = 'rename' AND src <> dst").select(F.col("seq").alias("m"), "src", "dst").unionByName(events.filter("op = 'delete'").select(F.col("seq").alias("m"), F.col("tag").alias("src"), F.lit(None).cast("string").alias("dst"))))
    places = tag_places(tag_forest(changes))
    marks = changes.select(F.col("src").alias("tag"), F.col("m").alias("mark"))
    rows = events.filter("op IN ('parent', 'unparent') AND tag <> parent").select(F.col("seq").alias("id"), (F.col("op") == "unparent").alias("ends"), F.col("tag").alias("child"), "parent")

    def side(column: str) -> DataFrame:
        first = cut(V.following(rows.select("id", F.col(column).alias("tag")), marks, ["tag"], "id", "nx"))
        later = first.filter("nx IS NOT NULL").select("id", F.col("nx").alias("n")).join(places, "n").select("id", "tag", "nx", "since")
        return cut(first.withColumn("since", F.lit(-1).cast("long")).unionByName(later.select("id", "tag", "nx", "since")).withColumn("nx", F.coalesce("nx", F.lit(-1).cast("long"))))

    child, parent = side("child"), side("parent")
    live, ends = rows.filter("NOT ends").select("id"), rows.filter("ends").select("id")
    stop = ends.join(child.filter("since = -1").select("id", "tag", "nx"), "id").join(parent.filter("since = -1").select("id", F.col("tag").alias("tag2"), F.col("nx").alias("nx2")), "id")
    stop = stop.groupBy("tag", "nx", "tag2", "nx2").agg(F.max("id").alias("s"))
    near = live.join(child, "id").join(stop, ["tag", "nx"]).filter(F.col("s") > F.greatest("id", "since")).select("id", "s", "tag2", "nx2")
    far = parent.select("id", F.col("tag").alias("tag2"), F.col("nx").alias("nx2"), F.col("since").alias("since2"))
    dead = near.join(far, ["id", "tag2", "nx2"]).filter("s > since2").select("id").distinct()
    out = live.join(child.filter("nx = -1").select("id", "tag"), "id").join(parent.filter("nx = -1").select("id", F.col("tag").alias("parent")), "id")
    return out.filter("tag <> parent").join(dead, "id", "left_anti").select("tag", "parent").distinct()


def _last(events: DataFrame, start: str, stop: str, *values: str) -> DataFrame:
    """The last setting of each name that no later event took away."""
    held = events.filter(F.col("op").isin(start, stop)).groupBy("name").agg(F.max_by(F.struct("op", *values), "seq").alias("v"))
    return held.filter(F.col("v.op") == start).select("name", *[F.col(f"v.{c}").alias(c) for c in values])


def fold(events: DataFrame, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The state by table: items, attrs, relations, kept, types, cards, no_extract, reviews, relink_skips, aliases, parents, attr_defs, searches.

    A fact that comes to the place of another one (by a move) takes it over if
    it came later; under a tag both merge. Unknown kinds of events, moves of a
    root itself and moves to the same path change nothing; an empty log gives
    empty tables. ``tables``: those that are wanted, all if null.
    """
    wanted = set(tables or [*PLACED, *NAMED])
    e = whole(events)
    used = {r[0] for r in e.filter(F.col("op").isin("alias", "rename", "delete", "move")).select("op").distinct().collect()}
    placed = {t: f for t, f in PLACED.items() if t in wanted}
    e = cut(e) if used or len(wanted) > 1 else e
    spans = alias_spans(e) if "alias" in used else None
    out = {}
    if "aliases" in wanted:
        out["aliases"] = (alias_spans(e) if spans is None else spans).filter("until IS NULL").select("alias", "tag")
    if "parents" in wanted:
        out["parents"] = _parents(e)
    if "attr_defs" in wanted:
        out["attr_defs"] = _last(e, "attr-def", "attr-undef", "type", "choices")
    if "searches" in wanted:
        out["searches"] = _last(e, "search-save", "search-delete", "query")
    if not placed:
        return out
    held = facts(e, spans, set(placed.values()))
    if used:
        held = cut(held)
        moves = cut(e.filter("op = 'move' AND src <> '' AND src <> dst").select("root", F.col("seq").alias("m"), "src", "dst"))
        trees = V.forest(moves)
        if "relations" in wanted:
            out["relations"] = _relations(held, moves, trees)
        if set(placed) == {"relations"}:
            return out
        changes = tag_changes(e, spans) if used - {"move"} else None
        stand = standing(held.filter("fact <> 'relation'"), moves, trees, changes, bool({"attrs", "kept", "types", "cards", "reviews"} & set(placed)))
    else:  # nothing is re-keyed: the last event of each place counts
        last = held.groupBy("fact", "root", "path", "other", "key").agg(F.max_by(F.struct("id", "ends", "value"), "id").alias("l"))
        stand = last.filter("NOT l.ends").select("fact", "root", "path", "other", "key", F.col("l.id").alias("id"), F.col("l.value").alias("value"))
        if "relations" in wanted:
            out["relations"] = stand.filter("fact = 'relation'").select("root", F.col("path").alias("src"), F.col("other").alias("dst"), F.col("key").alias("kind"))
    if "attrs" in wanted:
        undefined = e.filter("op = 'attr-undef'").groupBy(F.col("name").alias("key")).agg(F.max("seq").alias("undefined"))
        stand = stand.join(undefined, "key", "left").filter("fact <> 'attr' OR undefined IS NULL OR undefined < id").drop("undefined")
    one = cut(stand.groupBy("fact", "root", "path", "key").agg(F.max_by("value", "order").alias("value"))) if used else stand
    part = lambda i: F.split_part(F.col("value"), F.lit("\x1f"), F.lit(i))
    columns = {
        "items": [F.col("key").alias("tag")],
        "attrs": [F.col("key").alias("name"), F.col("value")],
        "kept": [F.col("value").alias("reason")],
        "types": [F.col("value").alias("type")],
        "cards": [part(1).alias("description"), part(2).alias("naming")],
        "no_extract": [],
        "reviews": [F.col("key").alias("sha256"), F.col("value").alias("decision")],
        "relink_skips": [F.col("key").alias("sha256")],
    }
    return out | {t: one.filter(F.col("fact") == placed[t]).select("root", "path", *c) for t, c in columns.items() if t in placed}
