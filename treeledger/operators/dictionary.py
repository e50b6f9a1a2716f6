"""The tag dictionary (aliases, parents) and the order of moves that happened at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.shared import cut

#: Hops from alias to name: 2**ROUNDS, a bound against cycles.
ROUNDS = 5


def canonical_names(aliases: DataFrame) -> DataFrame:
    """(alias, tag): the name that each alias leads to, over at most 32 hops; a name that was passed before ends the chain.

    Ways of 1, 2, 4, ... hops are composed, so chains of any length take
    ``ROUNDS`` joins. ``aliases``: alias, tag, one row an alias.
    """
    way = aliases.filter("alias <> tag").select("alias", F.array("tag").alias("way"), F.lit(True).alias("full"))
    for _ in range(ROUNDS):
        far = way.select(F.col("alias").alias("at"), F.col("way").alias("more"), F.col("full").alias("more_full"))
        both = way.withColumn("at", F.when(F.col("full"), F.element_at("way", -1))).join(far, "at", "left")
        way = cut(both.select("alias", F.when(F.col("more").isNotNull(), F.concat("way", "more")).otherwise(F.col("way")).alias("way"), F.coalesce("more_full", F.lit(False)).alias("full")))
    names = F.concat(F.array("alias"), "way")
    again = F.filter(F.sequence(F.lit(2), F.size(names)), lambda i: F.array_position(names, F.element_at(names, i)) < i)
    return way.select("alias", F.element_at(names, F.coalesce(F.get(again, F.lit(0)), F.size(names))).alias("tag"))


def canonical(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by the name it is an alias of; names: see ``canonical_names``."""
    held = names.select(F.col("alias").alias("__alias"), F.col("tag").alias("__name"))
    return rows.join(held, F.col(column) == F.col("__alias"), "left").withColumn(column, F.coalesce("__name", F.col(column))).drop("__alias", "__name")


def add_aliases(wanted: DataFrame, items: DataFrame, aliases: DataFrame, parents: DataFrame) -> DataFrame:
    """What each request (seq, tag, alias) for an alias comes to: seq, outcome, and the events' names src and dst.

    ``refused``: both names are one already. ``rename``: the alias is in use as
    a tag (on items, or in the dictionary), so what bears it is renamed before
    it becomes an alias. ``alias`` otherwise. ``later``: an earlier request of
    the same batch changes one of its names; it is to be asked again.
    """
    names = canonical_names(aliases)
    asked = canonical(wanted.select("seq", "tag", "alias", F.col("alias").alias("was")), names, "tag")
    asked = canonical(asked, names, "was")
    touched = asked.select("seq", F.explode(F.array_distinct(F.array("tag", "alias", "was"))).alias("name"))
    first = touched.groupBy("name").agg(F.min("seq").alias("first"))
    late = touched.join(first, "name").filter("first < seq").select("seq").distinct().withColumn("late", F.lit(True))
    used = items.select(F.col("tag").alias("alias")).union(aliases.select("tag")).union(parents.select("tag")).union(parents.select("parent")).distinct().withColumn("used", F.lit(True))
    held = asked.join(late, "seq", "left").join(used, "alias", "left")
    outcome = F.when(F.col("late"), "later").when((F.col("was") == F.col("tag")) | (F.col("alias") == F.col("tag")), "refused").when(F.col("used"), "rename").otherwise("alias")
    return held.select("seq", outcome.alias("outcome"), F.col("alias").alias("src"), F.col("tag").alias("dst"))


def closure(pairs: DataFrame) -> DataFrame:
    """(tag, up): everything that is reached from each tag, by doubling; a tag in a ring reaches itself."""
    out = cut(pairs.select("tag", F.col("parent").alias("up")).distinct())
    n = out.count()
    while True:
        more = cut(out.union(out.join(out.select(F.col("tag").alias("up"), F.col("up").alias("top")), "up").select("tag", F.col("top").alias("up"))).distinct())
        m = more.count()
        if m == n:
            return more
        out, n = more, m


def add_parents(wanted: DataFrame, parents: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each request (seq, tag, parent) with outcome ``added``, ``known`` or ``refused``, as if asked one after the other.

    A request is refused if its parent is, or leads to, its tag. Requests that
    no ring of all pairs goes through are added at once; of the others, the
    first one of each knot of rings is decided in a round, so rounds grow with
    the requests that really contend.
    """
    names = canonical_names(aliases)
    asked = canonical(canonical(wanted.select("seq", "tag", "parent"), names, "tag"), names, "parent")
    known = parents.select("tag", "parent").distinct()
    here = asked.join(known.withColumn("there", F.lit(True)), ["tag", "parent"], "left")
    first = F.row_number().over(W.partitionBy("tag", "parent").orderBy("seq"))
    state = F.when(F.col("tag") == F.col("parent"), "refused").when(F.col("there"), "known")
    here = cut(here.withColumn("nth", first).withColumn("outcome", state).drop("there"))
    done = [here.filter("outcome IS NOT NULL").select("seq", "tag", "parent", "outcome")]
    open_ = cut(here.filter("outcome IS NULL AND nth = 1").select("seq", "tag", "parent"))
    repeats = here.filter("outcome IS NULL AND nth > 1").select("seq", "tag", "parent")
    held = cut(known)
    while not open_.isEmpty():
        reach = closure(held.unionByName(open_.select("tag", "parent")))
        back = reach.select(F.col("tag").alias("parent"), F.col("up").alias("tag")).withColumn("ring", F.lit(True))
        split = cut(open_.join(back, ["tag", "parent"], "left"))
        free = split.filter("ring IS NULL").drop("ring")
        done.append(free.withColumn("outcome", F.lit("added")))
        held = cut(held.unionByName(free.select("tag", "parent")))
        # a knot is named by the smallest tag that it reaches and that reaches it
        mutual = reach.join(reach.select(F.col("up").alias("tag"), F.col("tag").alias("up")), ["tag", "up"]).groupBy("tag").agg(F.least(F.col("tag"), F.min("up")).alias("knot"))
        rings = split.filter("ring").drop("ring").join(mutual, "tag")
        next_ = cut(rings.groupBy("knot").agg(F.min(F.struct("seq", "tag", "parent")).alias("r")).select("r.*"))
        if next_.isEmpty():
            break
        now = closure(held).select(F.col("tag").alias("parent"), F.col("up").alias("tag")).withColumn("ring", F.lit(True))
        judged = cut(next_.join(now, ["tag", "parent"], "left").withColumn("outcome", F.when(F.col("ring"), "refused").otherwise("added")).select("seq", "tag", "parent", "outcome"))
        done.append(judged)
        held = cut(held.unionByName(judged.filter("outcome = 'added'").select("tag", "parent")))
        open_ = cut(rings.select("seq", "tag", "parent").join(next_.select("seq"), "seq", "left_anti"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df.select("seq", "tag", "parent", "outcome"))
    same = out.filter("outcome <> 'known'").groupBy("tag", "parent").agg(F.first("outcome").alias("was"))
    later = repeats.join(same, ["tag", "parent"]).select("seq", "tag", "parent", F.when(F.col("was") == "added", "known").otherwise("refused").alias("outcome"))
    return out.unionByName(later)


def dictionary(items: DataFrame, aliases: DataFrame, parents: DataFrame) -> DataFrame:
    """Every tag in use or in the dictionary, with its aliases, parents and children in order; an alias stands under the name it is set to."""
    names = items.select("tag").union(aliases.select("tag")).union(parents.select("tag")).union(parents.select("parent")).distinct()
    listed = lambda df, key, value, into: df.groupBy(F.col(key).alias("tag")).agg(F.sort_array(F.collect_set(value)).alias(into))
    out = names.join(listed(aliases, "tag", "alias", "aliases"), "tag", "left").join(listed(parents, "tag", "parent", "parents"), "tag", "left").join(listed(parents, "parent", "tag", "children"), "tag", "left")
    return out.select("tag", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("aliases", "parents", "children")])


def touching(moves: DataFrame, paths: DataFrame) -> DataFrame:
    """The moves (root, src, dst) whose source holds, or is, a path with metadata (root, path)."""
    up = paths.select("root", F.explode(P.self_and_ancestors(F.col("path"))).alias("src")).distinct()
    return moves.join(up, ["root", "src"], "left_semi")


def ordered_moves(moves: DataFrame) -> DataFrame:
    """Moves that happened at once, in an order in which they can be applied one after the other: root, src, dst, level, cyclic, place.

    A move comes before another one if its source lies below the other's (what
    is inside goes first), or if the other's destination is its source or below
    it (a place is vacated before it is filled). ``level`` counts the moves
    that have to come before, along the longest chain; moves of a ring, and
    those that wait for one, are ``cyclic`` and come last, the deepest first.
    Rounds grow with the longest chain. Repeated moves count once.
    """
    held = cut(moves.select("root", "src", "dst").distinct())
    a = held.select("root", F.col("src").alias("s1"), F.col("dst").alias("d1"))
    inside = held.select("root", "src", "dst", F.explode(P.ancestors(F.col("src"))).alias("up")).join(a.withColumn("up", F.col("s1")), ["root", "up"]).select("root", "src", "dst", "s1", "d1")
    filled = held.select("root", F.col("src").alias("s1"), F.col("dst").alias("d1"), F.explode(P.self_and_ancestors(F.col("dst"))).alias("src")).join(held, ["root", "src"]).select("root", "src", "dst", "s1", "d1")
    edges = cut(inside.unionByName(filled).filter("src <> s1 OR dst <> d1").distinct())  # (src, dst) before (s1, d1)
    left, out, level = held, [], 0
    while True:
        waiting = edges.select("root", F.col("s1").alias("src"), F.col("d1").alias("dst")).distinct()
        ready = cut(left.join(waiting, ["root", "src", "dst"], "left_anti"))
        if ready.isEmpty():
            break
        out.append(ready.select("*", F.lit(level).alias("level"), F.lit(False).alias("cyclic")))
        left = cut(left.join(ready, ["root", "src", "dst"], "left_anti"))
        edges = cut(edges.join(ready, ["root", "src", "dst"], "left_anti"))
        level += 1
    out.append(left.select("*", F.lit(level).alias("level"), F.lit(True).alias("cyclic")))
    done = out[0]
    for df in out[1:]:
        done = done.unionByName(df)
    place = F.row_number().over(W.partitionBy("root").orderBy("level", -P.depth(F.col("src")), "src", "dst"))
    return done.withColumn("place", place)
