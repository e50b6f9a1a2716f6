"""Reconciliation of an observed tree with the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.shared import cut

KEY = ["root", "relpath"]


def diff(live: DataFrame, observed: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Each path's state: same, changed, new or missing. Paths at or under unreadable folders are never missing."""
    a = live.select(*KEY, F.col("is_dir").alias("o_dir"), F.col("size").alias("o_size"), F.col("mtime_ns").alias("o_mtime"), F.col("inode").alias("o_inode"), F.lit(True).alias("was"))
    b = observed.select(*KEY, "is_dir", "size", "mtime_ns", "inode", F.lit(True).alias("now"))
    same = F.col("o_dir").eqNullSafe(F.col("is_dir")) & F.col("o_size").eqNullSafe(F.col("size")) & F.col("o_mtime").eqNullSafe(F.col("mtime_ns")) & F.col("o_inode").eqNullSafe(F.col("inode"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(same, "same").otherwise("changed")
    out = a.join(b, KEY, "full_outer").withColumn("state", state).drop("was", "now")
    if unreadable is None:
        return out
    blind = out.filter("state = 'missing'").select(*KEY, F.explode(P.self_and_ancestors(F.col("relpath"))).alias("up"))
    blind = blind.join(unreadable.select("root", F.col("relpath").alias("up")), ["root", "up"], "left_semi").select(*KEY).distinct()
    return out.join(blind.withColumn("blind", F.lit(True)), KEY, "left").withColumn("state", F.when(F.col("blind"), "same").otherwise(F.col("state"))).drop("blind")


def inode_pairs(changes: DataFrame) -> DataFrame:
    """(root, old_relpath, new_relpath, is_dir): a missing path and a new one with the same inode.

    Exactly one missing path may hold the inode; of several new ones the first
    by path takes it.
    """
    key = ["root", "inode", "is_dir"]
    gone = changes.filter("state = 'missing'").select("root", F.col("relpath").alias("old_relpath"), F.col("o_inode").alias("inode"), F.col("o_dir").alias("is_dir"))
    gone = gone.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*key))).filter("n = 1").drop("n")
    new = changes.filter("state = 'new'").groupBy(*key).agg(F.min("relpath").alias("new_relpath"))
    return gone.join(new, key).select("root", "old_relpath", "new_relpath", "is_dir")


def inode_moves(changes: DataFrame) -> DataFrame:
    """The pairs of ``inode_pairs``, without those that a moved parent folder implies (same name below it)."""
    moves = inode_pairs(changes)
    p = moves.select("*", P.parent(F.col("old_relpath")).alias("po"), P.parent(F.col("new_relpath")).alias("pn"))
    dirs = moves.filter("is_dir").select("root", F.col("old_relpath").alias("po"), F.col("new_relpath").alias("pn"))
    implied = p.filter(P.basename(F.col("old_relpath")) == P.basename(F.col("new_relpath"))).join(dirs, ["root", "po", "pn"], "left_semi")
    return moves.join(implied.select("root", "old_relpath"), ["root", "old_relpath"], "left_anti")


def scan_counters(changes: DataFrame, moves: DataFrame) -> DataFrame:
    """Files (not folders) seen, added, changed, moved and gone per root; moved files are neither added nor gone."""
    files = changes.withColumn("d", F.coalesce("is_dir", "o_dir")).filter("NOT d")
    n = lambda c: F.count(F.when(c, 1))
    s = F.col("state")
    per = files.groupBy("root").agg(n(s != "missing").alias("seen"), n(s == "new").alias("new"), n(s == "changed").alias("changed"), n(s == "missing").alias("missing"))
    moved = moves.filter("NOT is_dir").groupBy("root").agg(F.count(F.lit(1)).alias("moved"))
    per = per.join(moved, "root", "left").withColumn("moved", F.coalesce("moved", F.lit(0)))
    return per.select("root", "seen", (F.col("new") - F.col("moved")).alias("added"), "changed", "moved", (F.col("missing") - F.col("moved")).alias("gone"))


def safety_valve(changes: DataFrame, least: int = 100, ratio: float = 0.2) -> DataFrame:
    """Per root whether missing files exceed max(least, int(live * ratio)), and so are held until missed again."""
    files = changes.filter("NOT o_dir")
    per = files.groupBy("root").agg(F.count(F.lit(1)).alias("live"), F.count(F.when(F.col("state") == "missing", 1)).alias("missing"))
    return per.withColumn("hold", F.col("missing") > F.greatest(F.lit(least), F.floor(F.col("live") * ratio)))


def relink_candidates(old: DataFrame, now: int, days: int = 30) -> DataFrame:
    """What may be found again: missing entries, and those that a scan gave up within ``days`` (never what a plan put aside). old: missing_count, gone_at (ns), gone_by."""
    recent = (F.col("gone_by") == "scan") & (F.col("gone_at") >= now - days * 86_400 * 1_000_000_000)
    return old.filter((F.col("gone_at").isNull() & (F.col("missing_count") > 0)) | recent)


def relink(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root, old_relpath, new_relpath, rule): gone or missing files found again by content.

    old: root, relpath, sha256, size, last_seen; new: root, relpath, sha256,
    size, first_seen. A pair needs the same content (size over 0) and old seen
    last before new was seen first. Rules in turn: the same path (of several
    old ones the one seen last); the only old and only new one of a content;
    the same name, if it is the only new one of that name and has just one
    partner that was seen in time.
    """
    key = ["root", "sha256", "size"]
    o = old.filter((F.col("size") > 0) & F.col("sha256").isNotNull()).groupBy(*key, F.col("relpath").alias("old_relpath")).agg(F.max("last_seen").alias("last_seen"))
    n = new.filter((F.col("size") > 0) & F.col("sha256").isNotNull()).select(*key, F.col("relpath").alias("new_relpath"), "first_seen")

    def settled(o: DataFrame, n: DataFrame, done: DataFrame):
        return o.join(done.select(*key, "old_relpath"), [*key, "old_relpath"], "left_anti"), n.join(done.select(*key, "new_relpath"), [*key, "new_relpath"], "left_anti")

    def once(df: DataFrame) -> DataFrame:
        alone = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter("c = 1").select(*key)
        return df.join(alone, key, "left_semi")

    pick = lambda df, rule: cut(df.filter("last_seen < first_seen").select(*key, "old_relpath", "new_relpath", F.lit(rule).alias("rule")))
    first = pick(o.withColumn("new_relpath", F.col("old_relpath")).join(n, [*key, "new_relpath"]), "path")
    o1, n1 = settled(o, n, first)
    second = pick(once(o1).join(once(n1), key), "content")
    o2, n2 = settled(o1, n1, second)
    named = [*key, "name"]
    lone = n1.withColumn("name", P.basename(F.col("new_relpath"))).groupBy(*named).agg(F.count(F.lit(1)).alias("rivals")).filter("rivals = 1").select(*named)
    mine = n2.withColumn("name", P.basename(F.col("new_relpath"))).join(lone, named, "left_semi")
    # of one name there is one new file at most, so it meets each old one of its name once
    met = mine.join(o2.withColumn("name", P.basename(F.col("old_relpath"))), named).filter("last_seen < first_seen")
    third = met.groupBy(*key, "new_relpath").agg(F.count(F.lit(1)).alias("c"), F.first("old_relpath").alias("old_relpath"), F.first("last_seen").alias("last_seen"), F.first("first_seen").alias("first_seen")).filter("c = 1")
    return first.union(second).union(pick(third, "name")).select("root", "old_relpath", "new_relpath", "rule")


def lineage(moves: DataFrame, queries: DataFrame, rounds: int = 32) -> DataFrame:
    """Names that a path had: (root, query_path, relpath, since, until), half open; moves of folders apply below them.

    moves: root, old_relpath, new_relpath, moved_at, move_id. Each step goes
    strictly back in time; it ends when no move matches, or after ``rounds``.
    """
    now = queries.select("root", F.col("relpath").alias("query_path"), "relpath", F.lit(None).cast("long").alias("until"))
    out = None
    for _ in range(rounds):
        up = now.withColumn("new_relpath", F.explode(P.self_and_ancestors(F.col("relpath")))).filter("new_relpath <> ''")
        hit = up.join(moves, ["root", "new_relpath"]).filter("until IS NULL OR moved_at < until")
        last = hit.groupBy("root", "query_path", "relpath").agg(F.max_by(F.struct("old_relpath", "new_relpath", "moved_at"), F.struct("moved_at", "move_id")).alias("m"))
        step = now.join(last, ["root", "query_path", "relpath"], "left")
        seg = step.select("root", "query_path", "relpath", F.col("m.moved_at").alias("since"), "until")
        out = seg if out is None else out.union(seg)
        nxt = step.filter("m IS NOT NULL").select("root", "query_path", F.concat("m.old_relpath", F.substring("relpath", F.length("m.new_relpath") + 1, F.length("relpath"))).alias("relpath"), F.col("m.moved_at").alias("until"))
        now = cut(nxt)
        if now.isEmpty():
            break
    return out


def snapshot_diff(files: DataFrame) -> DataFrame:
    """Consecutive snapshots of each root compared: counts, bytes lost and the alert.

    files: root, taken_at, relpath, size, mtime_ns. Pairs come from lag() over
    the few snapshots of a root; files join on the path. Alerts: deleted > 200
    and > 10 %, or changed > 300 and > 30 %.
    """
    shots = files.select("root", "taken_at").distinct()
    pairs = shots.withColumn("older", F.lag("taken_at").over(W.partitionBy("root").orderBy("taken_at"))).filter("older IS NOT NULL").withColumnRenamed("taken_at", "newer")
    a = files.join(pairs.withColumnRenamed("older", "taken_at"), ["root", "taken_at"]).select("root", "newer", "relpath", F.struct("size", "mtime_ns").alias("a"))
    b = files.join(pairs.select("root", F.col("newer").alias("taken_at")), ["root", "taken_at"]).select("root", F.col("taken_at").alias("newer"), "relpath", F.struct("size", "mtime_ns").alias("b"))
    j = a.join(b, ["root", "newer", "relpath"], "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    gone = F.col("b").isNull()
    per = j.groupBy("root", "newer").agg(
        n(F.col("a").isNotNull()).alias("before"),
        n(F.col("b").isNotNull()).alias("after"),
        n(gone).alias("deleted"),
        n(F.col("a") != F.col("b")).alias("changed"),
        n(F.col("a").isNull()).alias("added"),
        F.coalesce(F.sum(F.when(gone, F.col("a.size"))), F.lit(0)).alias("bytes_lost"),
    )
    base = F.greatest("before", F.lit(1))
    return per.withColumn("alert", ((F.col("deleted") > 200) & (F.col("deleted") > base * 0.1)) | ((F.col("changed") > 300) & (F.col("changed") > base * 0.3)))


def snapshot_only(files: DataFrame, live: DataFrame, least: int) -> DataFrame:
    """Versions (path, size) of ``least`` bytes or more that live files no longer hold, with their snapshots."""
    big = files.filter(F.col("size") >= least)
    lost = big.join(live.filter("NOT is_dir").select("root", "relpath", "size"), ["root", "relpath", "size"], "left_anti")
    return lost.groupBy("root", "relpath", "size").agg(F.count(F.lit(1)).alias("snapshots"), F.max("taken_at").alias("newest"))
