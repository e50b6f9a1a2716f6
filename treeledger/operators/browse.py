"""Listings of a catalog: pickers, children, details, work-lists and small summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions.text import name_key
from ..sources.shared import cut
from .hygiene import current_hash


def guarded_roots(roots: DataFrame, observations: DataFrame) -> DataFrame:
    """(root, seen, accepted): a root without any observation is not taken as "everything was deleted"."""
    seen = observations.groupBy("root").agg(F.count(F.lit(1)).alias("seen"))
    return roots.select("root").join(seen, "root", "left").fillna(0, ["seen"]).withColumn("accepted", F.col("seen") > 0)


def scan_exclusions(types: DataFrame, replicas: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, relpath, reason): folders of type exclude, replicas, and other roots inside a root.

    types: root, path, type; replicas: root, relpath, original; roots: root, path (absolute).
    """
    typed = types.filter("type = 'exclude' AND path <> ''").select("root", F.col("path").alias("relpath"), F.lit("type").alias("reason"))
    copies = replicas.select("root", F.regexp_replace("relpath", "^/+|/+$", "").alias("relpath"), F.concat(F.lit("replica of "), "original").alias("reason"))
    inner = roots.select(F.col("root").alias("other"), F.col("path").alias("at"), F.explode(P.ancestors(F.col("path"))).alias("path"))
    nested = inner.join(roots, "path").select("root", F.expr("substring(at, length(path) + 2)").alias("relpath"), F.concat(F.lit("root "), "other").alias("reason"))
    return typed.union(copies).union(nested)


def hash_pending(entries: DataFrame) -> DataFrame:
    """Files whose content hash is missing or older than their size and time."""
    return entries.filter(~F.col("is_dir") & ~current_hash()).select("root", "relpath", "size")


def newest_state(rows: DataFrame) -> DataFrame:
    """Each path once: its live row (gone_at null), else the row that went last; applied after all other conditions."""
    w = W.partitionBy("root", "relpath").orderBy(F.col("gone_at").isNull().desc(), F.desc("gone_at"))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def folder_picker(folders: DataFrame, part: str, most: int = 50) -> DataFrame:
    """(root, relpath): the ``most`` shortest folder paths that hold ``part``; hidden ones are left out afterwards."""
    found = folders.filter(F.contains("relpath", F.lit(part))).orderBy(F.length("relpath"), "relpath", "root").limit(most)
    return found.filter(~P.hidden(F.col("relpath"))).select("root", "relpath")


def children(entries: DataFrame, folder: str) -> DataFrame:
    """(root, name, is_dir, files, size): what stands directly in ``folder``; folders with all that is below them."""
    rest = F.expr(f"substring(relpath, {len(folder) + 2})") if folder else F.col("relpath")
    below = entries.filter(F.col("relpath").startswith(folder + "/") if folder else F.lit(True)).withColumn("rest", rest)
    name = F.substring_index("rest", "/", 1)
    return below.groupBy("root", name.alias("name"), (F.contains("rest", F.lit("/")) | F.col("is_dir")).alias("is_dir")).agg(F.count(F.when(~F.col("is_dir"), 1)).alias("files"), F.sum("size").alias("size"))


def details(entries: DataFrame, extracts: DataFrame, tags: DataFrame, most: int = 20) -> DataFrame:
    """Per file: size, up to ``most`` other paths of the same content, length of its text and its own tags."""
    files = entries.filter(~F.col("is_dir")).select("root", "relpath", "size", "sha256")
    # the first paths of a content, by a window that stops early, so that no content's paths are all gathered
    w = W.partitionBy("root", "sha256").orderBy("relpath")
    first = files.filter("sha256 IS NOT NULL").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most + 1)
    same = first.groupBy("root", "sha256").agg(F.array_sort(F.collect_list("relpath")).alias("paths"))
    own = tags.groupBy("root", F.col("path").alias("relpath")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    text = extracts.select("sha256", F.length("text").alias("chars"))
    out = files.join(same, ["root", "sha256"], "left").join(text, "sha256", "left").join(own, ["root", "relpath"], "left")
    others = F.slice(F.filter("paths", lambda p: p != F.col("relpath")), 1, most)
    return out.select("root", "relpath", "size", F.coalesce(F.array_join(others, "|"), F.lit("")).alias("same"), "chars", F.coalesce("tags", F.lit("")).alias("tags"))


def text_slice(texts: DataFrame, offset: int, most: int) -> DataFrame:
    """``texts`` with ``part``, ``most`` characters from ``offset`` on, and whether there is more."""
    return texts.withColumn("part", F.expr(f"substring(text, {offset + 1}, {most})")).withColumn("truncated", F.length("text") > offset + most)


def tagged(tags: DataFrame, entries: DataFrame, tag: str, under: str = "") -> DataFrame:
    """(root, path, exists): what carries ``tag`` itself; exists if something of the path or below it is live."""
    held = tags.filter((F.col("tag") == tag) & P.under(F.col("path"), under)).select("root", "path")
    live = entries.select("root", F.explode(P.self_and_ancestors(F.col("relpath"))).alias("path")).join(held, ["root", "path"], "left_semi").distinct()
    return held.join(live.withColumn("e", F.lit(True)), ["root", "path"], "left").select("root", "path", F.coalesce("e", F.lit(False)).alias("exists"))


def last_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the highest ``order`` for each ``key``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("v")).select("v.*")


def largest_by_kind(entries: DataFrame, most: int = 50) -> DataFrame:
    """The largest files of each root and kind, ties by path."""
    w = W.partitionBy("root", "kind").orderBy(F.desc("size"), "relpath")
    held = entries.filter(~F.col("is_dir")).withColumn("kind", N.kind(F.col("relpath"))).filter("kind IS NOT NULL")
    return held.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("root", "kind", "rank", "relpath", "size")


def folder_profiles(entries: DataFrame, most: int = 40) -> DataFrame:
    """(root, dir, names): the first names of each folder's files, in order of path."""
    held = entries.filter(~F.col("is_dir")).select("root", P.parent(F.col("relpath")).alias("dir"), "relpath")
    w = W.partitionBy("root", "dir").orderBy("relpath")
    first = held.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("r", P.basename(F.col("relpath")).alias("name")))), lambda x: x["name"])
    return first.groupBy("root", "dir").agg(F.array_join(names, "|").alias("names"))


def naming_styles(entries: DataFrame) -> DataFrame:
    """(root, dir, style, files, share): the most frequent date form of each folder's dated names; ties by the form's name."""
    held = entries.filter(~F.col("is_dir")).select("root", P.parent(F.col("relpath")).alias("dir"), N.date_format(P.basename(F.col("relpath"))).alias("style")).filter("style IS NOT NULL")
    per = held.groupBy("root", "dir", "style").agg(F.count(F.lit(1)).alias("files"))
    w = W.partitionBy("root", "dir")
    per = per.withColumn("share", F.col("files") / F.sum("files").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("files"), "style")))
    return per.filter("r = 1").drop("r")


def facets(tags: DataFrame) -> DataFrame:
    """(facet, tags, items): tags by what stands before the colon, none for tags without one."""
    group = F.when(F.contains("tag", F.lit(":")), F.substring_index("tag", ":", 1)).otherwise("")
    return tags.groupBy(group.alias("facet")).agg(F.count_distinct("tag").alias("tags"), F.count(F.lit(1)).alias("items"))


def name_clashes(entries: DataFrame, key: Column) -> DataFrame:
    """(root, dir, key, names, first_name): names of one folder that a file system without case can't tell apart; ``key``: the folded name."""
    held = entries.select("root", P.parent(F.col("relpath")).alias("dir"), P.basename(F.col("relpath")).alias("name"), key.alias("key"))
    per = held.groupBy("root", "dir", "key").agg(F.count_distinct("name").alias("names"), F.min("name").alias("first_name"))
    return per.filter("names > 1")


def inbox_files(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """(root, inbox, relpath, elsewhere): files of the outermost folders whose name fits a pattern (letter case apart), and how many paths outside any inbox hold the same content.

    Hidden folders, OS files and office locks are left out.
    """
    from .hygiene import topmost

    rx = "(?i)(" + "|".join(P.glob_regex(p).replace("(?s)", "") for p in patterns) + ")"
    p = F.col("relpath")
    up = entries.select("root", F.explode(P.ancestors(p)).alias("dir")).filter("dir <> ''").distinct()
    found = topmost(up.filter(P.basename(F.col("dir")).rlike(rx) & ~P.hidden(F.col("dir"))))
    files = entries.filter(~F.col("is_dir")).select("root", "relpath", F.when(current_hash(), F.col("sha256")).alias("h"))
    inside = files.select("*", F.explode(P.ancestors(p)).alias("dir")).join(found, ["root", "dir"])
    name = P.basename(p)
    inside = inside.filter(~F.lower(name).isin(N.OS_JUNK) & ~name.rlike(N.OFFICE_LOCK)).select("root", F.col("dir").alias("inbox"), "relpath", "h")
    others = files.filter("h IS NOT NULL").join(inside.select("root", "relpath"), ["root", "relpath"], "left_anti")
    counts = others.groupBy("root", "h").agg(F.count(F.lit(1)).alias("elsewhere"))
    return inside.join(counts, ["root", "h"], "left").fillna(0, ["elsewhere"]).select("root", "inbox", "relpath", "elsewhere")


def cloud_paths(items: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, item_id): items (id, name, parent; null at the top) found by walking a path's parts, letter case and normal form apart, as deep as the deepest path."""
    named = cut(items.select(F.col("id").alias("item_id"), name_key(F.col("name")).alias("__name"), F.col("parent").alias("__parent")))
    rows = cut(paths.select("path", P.parts(name_key(F.col("path"))).alias("__p")))
    found = rows.withColumn("__at", F.get("__p", F.lit(0))).join(named.filter("__parent IS NULL"), F.col("__at") == F.col("__name")).select("path", "__p", "item_id")
    out = found.filter(F.size("__p") == 1)
    for i in range(1, rows.agg(F.max(F.size("__p"))).first()[0] or 1):
        step = found.filter(F.size("__p") > i).select("path", "__p", F.col("item_id").alias("__parent"), F.get("__p", F.lit(i)).alias("__name"))
        found = cut(step.join(named, ["__parent", "__name"]).select("path", "__p", "item_id"))
        out = out.union(found.filter(F.size("__p") == i + 1))
    return out.select("path", "item_id")


def relations_of(relations: DataFrame) -> DataFrame:
    """(item, direction, kind, other): every relation (src, kind, dst) from both sides."""
    out = relations.select(F.col("src").alias("item"), F.lit("out").alias("direction"), "kind", F.col("dst").alias("other"))
    return out.union(relations.select("dst", F.lit("in"), "kind", "src"))
