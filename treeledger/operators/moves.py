"""What a log of folder moves does to the places that other events name.

A place is (root, path) at a time. Its next move is the first later one whose
source is the path or a folder above. Moves form a forest: the parent of a
move is the next move of its destination, which takes along everything the
first one carried, unless a move in between takes a part of it out. So a place
goes up its tree in one step, whatever the number of moves, and only such
exits, at most one per folder level of its path, need a round of their own.
Trees are composed by pointer doubling: n chained moves take log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.shared import cut


def joined(base: Column, rest: Column) -> Column:
    """A path below another one; either may be empty."""
    return F.when(rest == "", base).when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))


def below(path: Column, base: Column) -> Column:
    """The part of ``path`` that stands below ``base``."""
    return F.when(base == "", path).otherwise(F.substring(path, F.length(base) + 2, F.length(path)))


def following(rows: DataFrame, marks: DataFrame, key: list[str], at: str, into: str) -> DataFrame:
    """``rows`` with ``into``, the smallest ``mark`` after ``at`` with the same key; marks: key, mark.

    Both are dealt by ranges of (key, time), so that a key with most of the
    rows is spread; what a range lacks comes from the ranges after it, one
    number for each range that ends inside a key.
    """
    held = rows.select("*", F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__m"))
    held = held.unionByName(marks.select(*key, F.col("mark").alias("__t"), F.lit(0).alias("__kind"), F.col("mark").alias("__m")), allowMissingColumns=True)
    order = ["__t", "__kind"]
    dealt = cut(held.repartitionByRange(*key, *order).withColumn("__range", F.spark_partition_id()))
    later = W.partitionBy(*key).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    heads = dealt.groupBy(*key, "__range").agg(F.min("__m").alias("__head")).withColumn("__next", F.last("__head", ignorenulls=True).over(later)).filter("__next IS NOT NULL").drop("__head")
    inside = W.partitionBy(*key, "__range").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    near = dealt.withColumn("__near", F.last("__m", ignorenulls=True).over(inside)).filter("__kind = 1")
    return near.join(F.broadcast(heads), [*key, "__range"], "left").withColumn(into, F.coalesce("__near", "__next")).select(*rows.columns, into)


def next_moves(rows: DataFrame, moves: DataFrame, path: str, at: str, ident: list[str]) -> DataFrame:
    """``rows`` (``ident`` tells them apart) with their next move ``n`` and the path ``rest`` below its source; nulls if there is none."""
    sources = moves.select("root", F.col("src").alias("__src"), F.col("m").alias("mark"))
    up = rows.select(*dict.fromkeys([*ident, "root", at]), F.col(path).alias("__path"), F.explode(P.self_and_ancestors(F.col(path))).alias("__src"))
    up = up.join(sources.select("root", "__src").distinct(), ["root", "__src"], "left_semi")
    found = following(up, sources, ["root", "__src"], at, "n").filter("n IS NOT NULL")
    first = found.groupBy(*ident).agg(F.min(F.struct("n", below(F.col("__path"), F.col("__src")).alias("rest"))).alias("f"))
    return rows.join(first, ident, "left").select(*rows.columns, F.col("f.n").alias("n"), F.col("f.rest").alias("rest"))


def forest(moves: DataFrame) -> DataFrame:
    """The moves (root, m, src, dst) with their tree: up (parent), top (the tree's last move), q (what they carry stands at q in the frame of ``top``'s source), and the interval [pre, end] of their subtree in an order in which children follow their parent by time."""
    held = next_moves(moves.select("root", "m", "src", "dst"), moves, "dst", "m", ["root", "m"])
    level = cut(held.select("root", "m", "src", "dst", F.col("n").alias("up"), F.coalesce("n", "m").alias("j"), F.coalesce("rest", F.lit("")).alias("q"), F.col("n").isNotNull().alias("full"), F.lit(1).cast("long").alias("size")))
    levels = [level]
    key = ["root", "m"]
    while not level.filter("full").isEmpty():
        far = level.select("root", F.col("m").alias("j"), F.col("j").alias("j2"), F.col("q").alias("q2"), F.col("full").alias("full2"))
        more = level.filter("full").groupBy("root", F.col("j").alias("m")).agg(F.sum("size").alias("more"))
        new = level.join(far, ["root", "j"]).join(more, key, "left")
        level = cut(new.select("root", "m", "src", "dst", "up", F.col("j2").alias("j"), F.when(F.col("full"), joined(F.col("q2"), F.col("q"))).otherwise(F.col("q")).alias("q"), (F.col("full") & F.col("full2")).alias("full"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        levels.append(level)
    before = F.coalesce(F.sum("size").over(W.partitionBy("root", "up").orderBy("m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = cut(level.select("root", "m", F.when(F.col("up").isNull(), 0).otherwise(before + 1).cast("long").alias("p")))
    for at in levels[:-1]:  # sums of 2, 4, ... steps up
        hop = at.filter("full").select("root", "m", "j")
        far = hop.join(sums.select("root", F.col("m").alias("j"), F.col("p").alias("more")), ["root", "j"]).select("root", "m", "more")
        sums = cut(sums.join(far, key, "left").select("root", "m", (F.col("p") + F.coalesce("more", F.lit(0))).alias("p")))
    return cut(level.join(sums, key).select("root", "m", "src", "dst", "up", F.col("j").alias("top"), "q", F.col("p").alias("pre"), (F.col("p") + F.col("size") - 1).alias("end")))


def exits(trees: DataFrame) -> DataFrame:
    """(root, top, exit_path, pre, end, at, x): move ``x`` takes out what stands at ``exit_path`` of the tree's frame, after move ``at`` and before the next one that takes all."""
    strict = trees.select("root", F.col("m").alias("x"), F.col("src").alias("out"), F.explode(P.ancestors(F.col("src"))).alias("dst"))
    hosts = trees.select("root", "dst", F.col("m").alias("at"), "up", "top", "q", "pre", "end")
    held = strict.join(hosts, ["root", "dst"]).filter((F.col("x") > F.col("at")) & (F.col("up").isNull() | (F.col("x") < F.col("up"))))
    # the parent's frame begins at its source; what a tree's last move has carried is no longer in the tree
    ups = trees.select("root", F.col("m").alias("up"), F.col("q").alias("up_q"), F.col("src").alias("up_src"))
    inner = held.join(ups, ["root", "up"]).withColumn("exit_path", joined(F.col("up_q"), below(F.col("out"), F.col("up_src"))))
    last = held.filter("up IS NULL").withColumn("exit_path", below(F.col("out"), F.col("dst")))
    columns = ["root", "top", "exit_path", "pre", "end", "at", "x"]
    return cut(inner.select(*columns).unionByName(last.select(*columns)))


def segments(now: DataFrame, trees: DataFrame, ident: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Where places go: (segments, ends). now: ident, root, path, arrived, and n and rest of ``next_moves``.

    segments: ident, root, i (0, 1, ...), e (the move it enters its tree by),
    rest (below that move's source), arrived (when it came to that place), top,
    k (path in the tree's frame), x (the move that takes it out, -1 if none),
    pre. ends: ident, root, path, arrived: where it stands at last and since
    when, and n_segments.
    """
    ident = list(ident)
    ends = [now.filter("n IS NULL").select(*ident, "root", "path", "arrived", F.lit(0).alias("n_segments"))]
    now = now.filter("n IS NOT NULL").select(*ident, "root", F.col("n").alias("e"), "rest", "arrived")
    out, i, ways = [], 0, exits(trees)
    where = trees.select("root", F.col("m").alias("e"), "top", "q", F.col("pre").alias("pre"))
    tops = trees.select("root", F.col("m").alias("top"), F.col("dst").alias("top_dst"))
    while True:
        here = cut(now.join(where, ["root", "e"]).withColumn("k", joined(F.col("q"), F.col("rest"))).drop("q"))
        up = here.select(*ident, "root", "top", F.col("pre").alias("mine"), F.explode(P.self_and_ancestors(F.col("k"))).alias("exit_path")).filter("exit_path <> ''")
        hit = up.join(ways, ["root", "top", "exit_path"]).filter("mine BETWEEN pre AND end").groupBy(*ident).agg(F.min(F.struct("x", "at", "exit_path")).alias("hit"))
        here = cut(here.join(hit, ident, "left"))
        out.append(here.select(*ident, "root", F.lit(i).alias("i"), "e", "rest", "arrived", "top", "k", F.coalesce("hit.x", F.lit(-1).cast("long")).alias("x"), "pre"))
        done = here.filter("hit IS NULL").join(tops, ["root", "top"])
        ends.append(done.select(*ident, "root", joined(F.col("top_dst"), F.col("k")).alias("path"), F.col("top").alias("arrived"), F.lit(i + 1).alias("n_segments")))
        now = here.filter("hit IS NOT NULL").select(*ident, "root", F.col("hit.x").alias("e"), below(F.col("k"), F.col("hit.exit_path")).alias("rest"), F.col("hit.at").alias("arrived"))
        i += 1
        if now.isEmpty():
            break
    whole, last = out[0], ends[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    for df in ends[1:]:
        last = last.unionByName(df)
    return cut(whole), cut(last)
