"""Event-sourced metadata: fold of tag events, dictionary, effective tags and attributes, folder types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..sources.shared import cut as _cut
from .fold import fold


def fold_tags(events: DataFrame) -> DataFrame:
    """(root, path, tag): the tags that stand after all events, add, remove and move (also rename, delete and alias), in order of ``seq``."""
    return fold(events, ["items"])["items"]


def last_values(events: DataFrame) -> DataFrame:
    """(root, path, name, value): the last attribute set per key; an unset removes it."""
    last = W.partitionBy("root", "path", "name").orderBy(F.desc("seq"))
    held = events.filter(F.col("op").isin("attr-set", "attr-unset")).withColumn("r", F.row_number().over(last))
    return held.filter("r = 1 AND op = 'attr-set'").select("root", "path", "name", "value")


def tag_closure(parents: DataFrame) -> DataFrame:
    """(tag, up): all transitive parents; parents: tag, parent."""
    out = _cut(parents.select("tag", F.col("parent").alias("up")).distinct())
    n = out.count()
    while True:
        more = _cut(out.union(out.join(out.select(F.col("tag").alias("up"), F.col("up").alias("top")), "up").select("tag", F.col("top").alias("up"))).distinct())
        m = more.count()
        if m == n:
            return more
        out, n = more, m


def effective_tags(entries: DataFrame, tags: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(root, relpath, tag) of every file: its own tags, its folders' and, with ``closure``, what those imply.

    Tags are resolved once per folder, then joined to the folder's files, so
    the explosion over ancestors is per folder.
    """
    files = entries.filter("NOT is_dir").select("root", "relpath", P.parent(F.col("relpath")).alias("dir"))
    dirs = files.select("root", "dir").distinct()
    per_dir = dirs.select("root", "dir", F.explode(F.when(F.col("dir") == "", F.array("dir")).otherwise(P.self_and_ancestors(F.col("dir")))).alias("path")).join(tags, ["root", "path"]).select("root", "dir", "tag").distinct()
    own = files.join(tags.withColumnRenamed("path", "relpath"), ["root", "relpath"]).select("root", "relpath", "tag")
    out = files.join(per_dir, ["root", "dir"]).select("root", "relpath", "tag").union(own)
    if closure is not None:
        out = out.union(out.join(closure, "tag").select("root", "relpath", F.col("up").alias("tag")))
    return out.distinct()


def tag_search(entries: DataFrame, effective: DataFrame, include: list[str], mode: str = "and", exclude: list[str] = ()) -> DataFrame:
    """Files with all (or any) of ``include`` and none of ``exclude``."""
    files = entries.filter("NOT is_dir").select("root", "relpath")
    key = ["root", "relpath"]
    if include:
        hits = effective.filter(F.col("tag").isin(include)).groupBy(*key).agg(F.count_distinct("tag").alias("n"))
        files = files.join(hits.filter(F.col("n") >= (len(set(include)) if mode == "and" else 1)), key, "left_semi")
    return files.join(effective.filter(F.col("tag").isin(list(exclude))), key, "left_anti") if exclude else files


def effective_attributes(entries: DataFrame, values: DataFrame) -> DataFrame:
    """(root, relpath, name, value, from_path): an item's own value, else its nearest folder's."""
    up = entries.filter("NOT is_dir").select("root", "relpath", F.posexplode(P.self_and_ancestors(F.col("relpath"))).alias("d", "path"))
    hit = up.join(values, ["root", "path"])
    return hit.groupBy("root", "relpath", "name").agg(F.max_by(F.struct("value", "path"), "d").alias("v")).select("root", "relpath", "name", F.col("v.value").alias("value"), F.col("v.path").alias("from_path"))


#: Types that folders below take over, and types that say nothing about them.
INHERITED, OWN = ("bundle", "app", "inbox", "archive", "exclude"), ("dated", "numbered")


def set_folder_types(dirs: DataFrame, types: DataFrame) -> DataFrame:
    """(root, dir, type, origin, from_path): a folder's own type (``set``), else that of the nearest folder above whose type is handed down (``inherited``).

    dirs: root, dir; types: root, path, type. A ``normal`` folder above hands
    down nothing and ends the search; dated and numbered ones are passed over.
    """
    own = dirs.join(types.withColumnRenamed("path", "dir"), ["root", "dir"]).select("root", "dir", "type", F.lit("set").alias("origin"), F.col("dir").alias("from_path"))
    telling = types.filter(F.col("type").isin("normal", *INHERITED))
    up = dirs.join(own.select("root", "dir"), ["root", "dir"], "left_anti").select("root", "dir", F.posexplode(P.ancestors(F.col("dir"))).alias("d", "path")).filter("dir <> ''")
    near = up.join(telling, ["root", "path"]).groupBy("root", "dir").agg(F.max_by(F.struct("type", "path"), "d").alias("t"))
    return own.unionByName(near.filter("t.type <> 'normal'").select("root", "dir", F.col("t.type").alias("type"), F.lit("inherited").alias("origin"), F.col("t.path").alias("from_path")))


def folder_types(dirs: DataFrame, types: DataFrame, inferred: DataFrame) -> DataFrame:
    """(root, dir, type, origin, from_path): set, else inherited, else inferred (root, dir, type)."""
    known = set_folder_types(dirs, types)
    rest = inferred.join(dirs, ["root", "dir"], "left_semi").join(known.select("root", "dir"), ["root", "dir"], "left_anti")
    return known.unionByName(rest.select("root", "dir", "type", F.lit("inferred").alias("origin"), F.col("dir").alias("from_path")))


def inferred_folder_types(entries: DataFrame) -> DataFrame:
    """(root, dir, type) by markers and by the names of visible child folders: bundle, app, dated, numbered."""
    p = F.col("relpath")
    files = entries.filter("NOT is_dir").select("root", "relpath")
    dirs = files.select("root", F.explode(P.ancestors(p)).alias("relpath")).filter("relpath <> ''").distinct()
    kids = dirs.unionByName(files).select("root", P.parent(p).alias("dir"), P.basename(p).alias("name")).distinct()
    marked = kids.groupBy("root", "dir").agg(F.max(F.col("name").isin(N.VCS)).alias("vcs"), F.max(F.col("name").isin(".obsidian", "zotero.sqlite", "metadata.db") | F.lower("name").endswith(".lrcat")).alias("app"))
    sub = dirs.select("root", P.parent(p).alias("dir"), P.basename(p).alias("name")).filter(~F.col("name").startswith("."))
    share = sub.groupBy("root", "dir").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("name").rlike(N.DATED), 1)).alias("dated"), F.count(F.when(F.col("name").rlike(N.NUMBERED), 1)).alias("numbered"))
    enough = lambda c: (F.col(c) >= 2) & (F.col(c) >= F.col("n") * 0.6)
    kind = F.when(F.col("vcs"), "bundle").when(F.col("app"), "app").when(enough("dated"), "dated").when(enough("numbered"), "numbered")
    return marked.join(share, ["root", "dir"], "left").select("root", "dir", kind.alias("type")).filter("type IS NOT NULL")
