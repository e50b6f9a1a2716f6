"""What became of paths: folder moves, versions in snapshots, kept alerts, closed folders, chains, effects of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..sources.shared import cut
from .hygiene import outside, topmost


def folder_moves(moves: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(root, old_dir, new_dir): folders that moved as a whole.

    moves: root, old, new (files); before: root, relpath, sha256 of the files
    that are no longer where they were; after: the same of those now seen. A
    pair of folders follows from a move whose last parts agree. Wanted: one
    target, neither inside the other, the old folder no longer there and the
    new one not there before, all moves from the old folder to the same place,
    more than half of its files found there with the same content. Only the
    shallowest are reported.
    """
    o, n = P.parts(F.col("old")), P.parts(F.col("new"))
    most = F.least(F.size(o), F.size(n)) - 1
    tail = lambda p, i: F.slice(p, F.size(p) - i + 1, i)
    head = lambda p, i: F.array_join(F.slice(p, 1, F.size(p) - i), "/")
    same = F.filter(F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), lambda i: tail(o, i) == tail(n, i))
    pairs = moves.select("root", F.explode(F.transform(same, lambda i: F.struct(head(o, i).alias("old_dir"), head(n, i).alias("new_dir")))).alias("d")).select("root", "d.*").distinct()
    one = pairs.groupBy("root", "old_dir").agg(F.count(F.lit(1)).alias("c"), F.min("new_dir").alias("new_dir")).filter("c = 1 AND old_dir <> ''").drop("c")
    one = one.filter((F.col("old_dir") != F.col("new_dir")) & ~F.col("new_dir").startswith(F.concat("old_dir", F.lit("/"))) & ~F.col("old_dir").startswith(F.concat("new_dir", F.lit("/"))))
    dirs = lambda df: df.select("root", F.explode(P.ancestors(F.col("relpath"))).alias("dir")).distinct()
    one = one.join(dirs(after).withColumnRenamed("dir", "old_dir"), ["root", "old_dir"], "left_anti")
    known = dirs(before.unionByName(moves.select("root", F.col("old").alias("relpath"), F.lit(None).cast("string").alias("sha256")))).withColumnRenamed("dir", "new_dir")
    one = cut(one.join(known, ["root", "new_dir"], "left_anti").join(dirs(after).withColumnRenamed("dir", "new_dir"), ["root", "new_dir"], "left_semi"))
    there = F.concat("new_dir", F.expr("substring(path, length(old_dir) + 1)"))
    under = lambda df, c: df.withColumn("path", F.col(c)).withColumn("old_dir", F.explode(P.ancestors(F.col(c)))).join(one, ["root", "old_dir"])
    astray = under(moves, "old").filter(F.col("new") != there).select("root", "old_dir").distinct()
    held = under(before, "relpath").select("root", "old_dir", there.alias("relpath"), F.col("sha256").alias("h"))
    share = held.join(after.withColumnRenamed("sha256", "now"), ["root", "relpath"], "left").groupBy("root", "old_dir").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("h") == F.col("now"), 1)).alias("found"))
    good = one.join(astray, ["root", "old_dir"], "left_anti").join(share.filter("found * 2 > files"), ["root", "old_dir"], "left_semi")
    return topmost(good.withColumnRenamed("old_dir", "dir")).select("root", F.col("dir").alias("old_dir"), "new_dir")


def versions(segments: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(item, relpath, version, first_seen, last_seen, snapshots, size, mtime_ns): states of an item over the snapshots of its lineage.

    segments: item, relpath, since, until (null: open); snapshots: relpath,
    taken_at, size, mtime_ns. A version is a run of snapshots with one size and time.
    """
    t = F.col("taken_at")
    at = segments.join(snapshots, "relpath").filter((F.col("since").isNull() | (t >= F.col("since"))) & (F.col("until").isNull() | (t < F.col("until"))))
    w = W.partitionBy("item").orderBy("taken_at", "relpath")
    state = F.struct("relpath", "size", "mtime_ns")
    at = at.withColumn("new", (~state.eqNullSafe(F.lag(state).over(w))).cast("int")).withColumn("version", F.sum("new").over(w))
    return at.groupBy("item", "relpath", "version", "size", "mtime_ns").agg(F.min("taken_at").alias("first_seen"), F.max("taken_at").alias("last_seen"), F.count(F.lit(1)).alias("snapshots"))


def folder_as_of(snapshots: DataFrame, live: DataFrame, folder: str) -> DataFrame:
    """(root, taken_at, name, is_dir, exists_now): the children of ``folder`` in each snapshot, and whether they are still there."""
    rest = F.expr(f"substring(relpath, {len(folder) + 2})")
    kids = snapshots.filter(F.col("relpath").startswith(folder + "/")).select("root", "taken_at", F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir")).distinct()
    now = live.filter(F.col("relpath").startswith(folder + "/")).select("root", F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir")).distinct().withColumn("exists_now", F.lit(True))
    return kids.join(now, ["root", "name", "is_dir"], "left").fillna(False, ["exists_now"])


def kept_alerts(alerts: DataFrame, dismissed: DataFrame, most: int = 20) -> DataFrame:
    """(root, newer, seq): one alert a newer snapshot, the first; the last ``most`` of a root; those dismissed are gone."""
    first = alerts.groupBy("root", "newer").agg(F.min("seq").alias("seq"))
    w = W.partitionBy("root").orderBy(F.desc("seq"))
    return first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r").join(dismissed, ["root", "newer"], "left_anti")


def closed_folders(types: DataFrame, entries: DataFrame, closed: list[str] = ("bundle", "app", "exclude")) -> DataFrame:
    """(root, dir): outermost folders that are closed by their type, or by a marker in them unless their type is normal; types: root, path, type."""
    markers = N.VCS + N.APP_MARKERS
    typed = types.filter(F.col("type").isin(list(closed))).select("root", F.col("path").alias("dir"))
    path = entries.select("root", F.explode(P.self_and_ancestors(F.col("relpath"))).alias("p")).filter(P.basename(F.col("p")).isin(markers))
    marked = path.select("root", P.parent(F.col("p")).alias("dir")).filter("dir <> ''").distinct()
    normal = types.filter("type = 'normal'").select("root", F.col("path").alias("dir"))
    return topmost(typed.union(marked.join(normal, ["root", "dir"], "left_anti")).distinct())


def chains(entries: DataFrame, least: int = 3) -> DataFrame:
    """(root, dir, last, length): folders that hold one folder only, and so on, ``least`` long or more, from their top; pointers double each round."""
    p = F.col("relpath")
    files = entries.filter(~F.col("is_dir"))
    dirs = files.select("root", F.explode(P.ancestors(p)).alias("dir")).filter("dir <> ''").distinct()
    kids = dirs.groupBy("root", P.parent(F.col("dir")).alias("up")).agg(F.count(F.lit(1)).alias("c"), F.min("dir").alias("next")).filter("c = 1 AND up <> ''")
    full = files.select("root", P.parent(p).alias("up")).distinct()
    step = cut(kids.join(full, ["root", "up"], "left_anti").select("root", F.col("up").alias("dir"), F.col("next").alias("last"), F.lit(1).cast("long").alias("n")))
    tops = step.select("root", "dir").join(step.select("root", F.col("last").alias("dir")), ["root", "dir"], "left_anti")
    reach = step
    while True:
        on = reach.select("root", F.col("dir").alias("last"), F.col("last").alias("far"), F.col("n").alias("m"))
        longer = cut(reach.join(on, ["root", "last"], "left").select("root", "dir", F.coalesce("far", "last").alias("last"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.col("far").isNotNull().alias("grew")))
        reach = longer.drop("grew")
        if longer.filter("grew").isEmpty():
            break
    return reach.join(tops, ["root", "dir"], "left_semi").filter(F.col("n") + 1 >= least).select("root", "dir", "last", (F.col("n") + 1).alias("length"))


def after_plan(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """(root, old, relpath, gone): entries after moves and quarantines; ops: root, path, dest (null: quarantined). The deepest op above an entry counts."""
    up = entries.select("root", "relpath", F.posexplode(P.self_and_ancestors(F.col("relpath"))).alias("d", "path"))
    hit = up.join(ops, ["root", "path"]).groupBy("root", "relpath").agg(F.max_by(F.struct("path", "dest"), "d").alias("op"))
    out = entries.select("root", "relpath").join(hit, ["root", "relpath"], "left")
    to = F.when(F.col("op.dest").isNotNull(), F.concat("op.dest", F.expr("substring(relpath, length(op.path) + 1)"))).otherwise(F.col("relpath"))
    return out.select("root", F.col("relpath").alias("old"), to.alias("relpath"), (F.col("op").isNotNull() & F.col("op.dest").isNull()).alias("gone"))


def deletion_guard(entries: DataFrame, folders: DataFrame, limit: int) -> DataFrame:
    """(root, relpath, below, over): files and folders below each quarantined folder, and whether they reach ``limit``."""
    p = F.col("relpath")
    every = entries.select("root", F.explode(P.self_and_ancestors(p)).alias("at")).filter("at <> ''").distinct()
    below = every.select("root", "at", F.explode(P.ancestors(F.col("at"))).alias("relpath")).join(folders.select("root", "relpath"), ["root", "relpath"]).groupBy("root", "relpath").agg(F.count(F.lit(1)).alias("below"))
    return folders.select("root", "relpath").join(below, ["root", "relpath"], "left").fillna(0, ["below"]).withColumn("over", F.col("below") >= limit)


def kept_or_allowed(entries: DataFrame, kept: DataFrame, allow: list[str]) -> DataFrame:
    """(root, relpath): entries that are kept or below something kept, or that an allow pattern matches, itself or a folder above; kept: root, path."""
    up = entries.select("root", "relpath", F.explode(P.self_and_ancestors(F.col("relpath"))).alias("path")).filter("path <> ''")
    held = up.join(kept, ["root", "path"], "left_semi")
    if allow:
        rx = "|".join(P.glob_regex(p).replace("(?s)", "") for p in allow)
        held = held.union(up.filter(F.col("path").rlike("(?s)" + rx)))
    return held.select("root", "relpath").distinct()


def protected_folders(spared: DataFrame) -> DataFrame:
    """(root, dir): folders that hold something kept or allowed."""
    return spared.select("root", F.explode(P.ancestors(F.col("relpath"))).alias("dir")).filter("dir <> ''").distinct()


def closed_only(entries: DataFrame, closed: DataFrame) -> DataFrame:
    """(root, sha256): contents that occur below closed folders (root, dir) and nowhere else."""
    files = entries.filter(~F.col("is_dir") & F.col("sha256").isNotNull()).select("root", "relpath", "sha256")
    open_ = outside(files, closed.select("root", F.col("dir").alias("relpath")))
    return files.select("root", "sha256").distinct().join(open_.select("root", "sha256"), ["root", "sha256"], "left_anti")
