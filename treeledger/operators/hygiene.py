"""Roll-ups, hygiene findings, duplicates and structure issues of a catalog."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..functions.text import nfc, nfkc_casefold
from ..sources.shared import cut as _cut


def _file() -> Column:
    return ~F.col("is_dir")


def current_hash() -> Column:
    return F.col("sha256").isNotNull() & F.col("hashed_size").eqNullSafe(F.col("size")) & F.col("hashed_mtime_ns").eqNullSafe(F.col("mtime_ns"))


def with_folders(files: DataFrame) -> DataFrame:
    """``files`` and a row for every folder above them."""
    up = files.select("root", F.explode(P.ancestors(F.col("relpath"))).alias("relpath")).filter("relpath <> ''").distinct()
    return files.unionByName(up.withColumn("is_dir", F.lit(True)), allowMissingColumns=True)


def root_summary(entries: DataFrame) -> DataFrame:
    hashed = F.when(current_hash(), 1)
    return entries.filter(_file()).groupBy("root").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count(hashed).alias("hashed_files"), F.coalesce(F.sum(F.when(current_hash(), F.col("size"))), F.lit(0)).alias("hashed_bytes")
    )


def subtree_sizes(entries: DataFrame) -> DataFrame:
    """Files and bytes below every folder. Sums per parent folder come first, so a row is exploded per folder, not per file."""
    direct = entries.filter(_file()).groupBy("root", P.parent(F.col("relpath")).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    up = direct.select("root", "n", "b", F.explode(F.when(F.col("d") == "", F.array("d")).otherwise(P.self_and_ancestors(F.col("d")))).alias("dir"))
    return up.groupBy("root", "dir").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"))


def fan_out(entries: DataFrame, top: int = 15) -> DataFrame:
    per = entries.filter(_file()).groupBy("root", P.parent(F.col("relpath")).alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    return per.orderBy(F.desc("files"), "root", "dir").limit(top)


def topmost(folders: DataFrame) -> DataFrame:
    """(root, dir) rows without those below another one."""
    above = folders.select("root", F.col("dir"), F.explode(P.ancestors(F.col("dir"))).alias("up"))
    inner = above.join(folders.select("root", F.col("dir").alias("up")), ["root", "up"], "left_semi")
    return folders.join(inner.select("root", "dir").distinct(), ["root", "dir"], "left_anti")


def deepest(folders: DataFrame) -> DataFrame:
    """(root, dir) rows without those that hold another one."""
    held = folders.select("root", F.explode(P.ancestors(F.col("dir"))).alias("dir")).distinct()
    return folders.join(held, ["root", "dir"], "left_anti")


def _folders(entries: DataFrame) -> DataFrame:
    """(root, dir) of every folder, listed itself or above something listed."""
    p = F.col("relpath")
    return entries.select("root", F.explode(F.when(F.col("is_dir"), P.self_and_ancestors(p)).otherwise(P.ancestors(p))).alias("dir")).filter("dir <> ''").distinct()


def outside(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """``rows`` (root, relpath) that are neither in ``folders`` (root, relpath) nor below one of them."""
    up = rows.select("root", "relpath", F.explode(P.self_and_ancestors(F.col("relpath"))).alias("up"))
    covered = up.join(folders.select("root", F.col("relpath").alias("up")), ["root", "up"], "left_semi").select("root", "relpath").distinct()
    return rows.join(covered, ["root", "relpath"], "left_anti")


def _without(rows: DataFrame, paths: DataFrame | None) -> DataFrame:
    """``rows`` whose (root, relpath) is not in ``paths``."""
    return rows if paths is None else rows.join(paths, ["root", "relpath"], "left_anti")


def folder_findings(entries: DataFrame, spared: DataFrame | None = None, disabled: list[str] = ()) -> DataFrame:
    """Topmost regenerable, app-data and cache folders with the files and bytes below them, but for those in ``spared`` (root, relpath)."""
    dirs = _folders(entries).join(subtree_sizes(entries), ["root", "dir"], "left").fillna(0, ["files", "bytes"])
    name = P.basename(F.col("dir"))
    app_data = name.isin(N.APP_DATA) | F.lower(name).isin(N.CACHES) & (F.col("files") > 0)
    category = F.when(name.isin(N.REGENERABLE) & F.lit("regenerable" not in disabled), "regenerable").when(app_data & F.lit("app-data" not in disabled), "app-data")
    found = dirs.withColumn("category", category).filter("category IS NOT NULL")
    if spared is not None:
        found = found.join(spared.withColumnRenamed("relpath", "dir"), ["root", "dir"], "left_anti")
    return topmost(found).select("root", "category", F.col("dir").alias("relpath"), F.lit(True).alias("is_dir"), "files", F.col("bytes").alias("size"))


def no_extension_folders(entries: DataFrame, least: int = 500) -> DataFrame:
    """Deepest folders of which half the files or more, and ``least`` or more, have no extension."""
    files = entries.filter(_file() & ~P.has_part(F.col("relpath"), N.VCS))
    bare = F.when(P.extension(F.col("relpath")) == "", 1).otherwise(0)
    direct = files.groupBy("root", P.parent(F.col("relpath")).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(bare).alias("b"))
    up = direct.filter("d <> ''").select("root", "n", "b", F.explode(P.self_and_ancestors(F.col("d"))).alias("dir")).filter("dir <> ''")
    per = up.groupBy("root", "dir").agg(F.sum("n").alias("files"), F.sum("b").alias("bare")).filter((F.col("bare") >= least) & (F.col("bare") * 2 >= F.col("files")))
    return deepest(per)


def file_findings(entries: DataFrame, devices: list[str] = ()) -> DataFrame:
    """Files by name and size; conflict copies only beside their original, for review unless both have the same content."""
    p = F.col("relpath")
    files = entries.filter(_file()).select("root", "relpath", "size", F.when(current_hash(), F.col("sha256")).alias("h"), P.parent(p).alias("dir"), P.basename(p).alias("name"), N.classify_file(p, F.col("size"), devices).alias("category"), N.conflict_original(p, devices).alias("original"))
    plain = files.filter("category <> 'conflict'").select("root", "category", "relpath", F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("files"), "size", F.lit(False).alias("needs_review"))
    beside = files.select("root", "dir", F.col("name").alias("original"), F.col("h").alias("oh"))
    copies = files.filter("category = 'conflict'").join(beside, ["root", "dir", "original"])
    same = F.coalesce(F.col("h") == F.col("oh"), F.lit(False))
    return plain.union(copies.select("root", "category", "relpath", F.lit(False), F.lit(1).cast("long"), "size", ~same))


def required(entries: DataFrame, devices: list[str] = (), versions: DataFrame | None = None) -> DataFrame:
    """(root, relpath, requires, requires_size, requires_mtime_ns): what a finding relies on.

    A conflict copy relies on its original beside it, an old version (of
    ``versions``, see ``old_versions``) on the later one; a folder's size is -1,
    so only that it is there counts.
    """
    p = F.col("relpath")
    files = entries.filter(_file()).select("root", "relpath", "size", "mtime_ns", P.parent(p).alias("dir"), P.basename(p).alias("name"), N.classify_file(p, F.col("size"), devices).alias("category"), N.conflict_original(p, devices).alias("original"))
    beside = files.select("root", "dir", F.col("name").alias("original"), p.alias("requires"), F.col("size").alias("requires_size"), F.col("mtime_ns").alias("requires_mtime_ns"))
    columns = ["root", "relpath", "requires", "requires_size", "requires_mtime_ns"]
    out = files.filter("category = 'conflict'").join(beside, ["root", "dir", "original"]).select(*columns)
    if versions is None:
        return out
    newer = old_versions(entries, versions).select("root", "relpath", F.col("newer").alias("requires"))
    now = files.select("root", p.alias("requires"), F.col("size").alias("requires_size"), F.col("mtime_ns").alias("requires_mtime_ns"))
    later = newer.join(now, ["root", "requires"], "left").withColumn("requires_size", F.coalesce("requires_size", F.lit(-1))).withColumn("requires_mtime_ns", F.coalesce("requires_mtime_ns", F.lit(-1)))
    return out.unionByName(later.join(out, ["root", "relpath"], "left_anti").select(*columns))


def old_versions(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root, relpath, newer, is_dir, files, size): what is there still and has a later version there still; pairs: root, old, newer (the last path counts)."""
    p = F.col("relpath")
    files = entries.filter(_file()).select("root", "relpath", F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("files"), "size")
    below = subtree_sizes(entries).select("root", F.col("dir").alias("relpath"), "files", F.col("bytes").alias("size"))
    zero = F.lit(0).cast("long")
    dirs = _folders(entries).withColumnRenamed("dir", "relpath").join(below, ["root", "relpath"], "left").select("root", "relpath", F.lit(True).alias("is_dir"), F.coalesce("files", zero).alias("files"), F.coalesce("size", zero).alias("size"))
    live = files.union(dirs).withColumn("key", nfc(p))
    held = pairs.select("root", nfc(F.col("old")).alias("key"), nfc(F.col("newer")).alias("new_key"))
    there = live.select("root", F.col("key").alias("new_key"), p.alias("newer"))
    last = held.join(there, ["root", "new_key"]).groupBy("root", "key").agg(F.max("newer").alias("newer"))
    return live.join(last, ["root", "key"]).select("root", "relpath", "newer", "is_dir", "files", "size")


def findings(
    entries: DataFrame,
    now_ns: int | None = None,
    least_bare: int = 500,
    stale_bytes: int = 500 << 20,
    stale_days: int = 365,
    spared: DataFrame | None = None,
    versions: DataFrame | None = None,
    disabled: list[str] = (),
) -> DataFrame:
    """What a tree's hygiene asks for, each path once: folders by name, then folders of files without extension,
    files by name and size, empty folders, extracted archives, old versions, and large files not touched for long.

    A path that an earlier rule reported, or that is in a folder reported, is left to that rule. Archives and
    stale files are for review. ``spared`` (root, relpath: kept or allowed entries, see ``history.kept_or_allowed``)
    is never reported, nor is a folder that holds any of it, so that it can't go with its folder. ``versions``
    (root, old, newer) names later versions. Rules of ``disabled`` categories don't report, so later ones may.
    """
    columns = ["root", "category", "relpath", "is_dir", "files", "size", "needs_review"]
    entries = _cut(entries.select("root", "relpath", "is_dir", "size", "mtime_ns", "sha256", "hashed_size", "hashed_mtime_ns"))
    on = lambda rows, category: rows.filter(F.lit(category not in disabled))
    held = None  # what is spared and the folders above it
    if spared is not None:
        spared = _cut(spared.select("root", "relpath").distinct())
        held = _cut(spared.select("root", F.explode(P.self_and_ancestors(F.col("relpath"))).alias("relpath")).filter("relpath <> ''").distinct())

    def row(rows: DataFrame, category: str, is_dir=False, files=1, size="size", review: bool = False) -> DataFrame:
        value = lambda v, kind: F.col(v) if isinstance(v, str) else F.lit(v).cast(kind)
        return rows.select("root", F.lit(category).alias("category"), "relpath", value(is_dir, "boolean").alias("is_dir"), value(files, "long").alias("files"), value(size, "long").alias("size"), F.lit(review).alias("needs_review"))

    named = _cut(folder_findings(entries, held, disabled).withColumn("needs_review", F.lit(False)))
    rest = _without(outside(entries.filter(_file()), named), spared)
    bare = on(_without(no_extension_folders(rest, least_bare).select("root", F.col("dir").alias("relpath")), held), "app-data")
    sizes = subtree_sizes(rest.filter(~P.has_part(F.col("relpath"), N.VCS))).withColumnRenamed("dir", "relpath")
    bare = row(bare.join(sizes, ["root", "relpath"]), "app-data", True, "files", "bytes")
    folders = _cut(named.select(columns).unionByName(bare))
    files = _without(file_findings(entries), spared).filter(~F.col("category").isin(list(disabled)))
    files = _cut(outside(files, folders).select(columns))
    empty = on(row(_without(outside(empty_folders(entries), folders), spared), "empty-dir", True, 0, 0), "empty-dir")
    packed = on(_without(_without(outside(extracted_archives(entries), folders), files), spared), "extracted-archive")
    found = folders.unionByName(files).unionByName(empty).unionByName(row(packed, "extracted-archive", review=True))
    reported = files.unionByName(row(packed, "extracted-archive"))
    if versions is not None:
        old = on(_without(_without(outside(old_versions(entries, versions), folders), reported.unionByName(empty)), held), "old-version")
        old = _cut(row(old, "old-version", "is_dir", "files"))
        found, reported = found.unionByName(old), reported.unionByName(old)
    now = time.time_ns() if now_ns is None else now_ns
    stale = _without(outside(stale_large(entries, stale_bytes, now - stale_days * 86_400_000_000_000), folders), reported)
    return found.unionByName(on(row(_without(stale, spared), "stale-large", review=True), "stale-large"))


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("findings"), F.sum("files").alias("files"), F.sum("size").alias("bytes"))


def duplicates(entries: DataFrame) -> DataFrame:
    """Groups of files with the same current content in one root."""
    held = entries.filter(_file() & (F.col("size") > 0) & current_hash())
    groups = held.groupBy("root", "sha256", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("relpath").alias("first_path"))
    return groups.filter("copies > 1").withColumn("waste", F.col("size") * (F.col("copies") - 1))


def extracted_archives(entries: DataFrame) -> DataFrame:
    """Archives beside a folder of the same stem."""
    p = F.col("relpath")
    dirs = entries.filter(_file()).select("root", F.explode(P.ancestors(p)).alias("stem_path")).filter("stem_path <> ''").distinct()
    rx = "(?i)(" + "|".join(e.replace(".", r"\.") for e in sorted(N.ARCHIVES, key=len, reverse=True)) + ")$"
    held = entries.filter(_file() & p.rlike(rx)).withColumn("stem_path", F.regexp_replace(p, rx, ""))
    return held.join(dirs, ["root", "stem_path"], "left_semi").select("root", "relpath", "size")


def empty_folders(entries: DataFrame) -> DataFrame:
    """Folders with nothing below them."""
    used = entries.select("root", F.explode(P.ancestors(F.col("relpath"))).alias("relpath")).distinct()
    return entries.filter("is_dir").select("root", "relpath").join(used, ["root", "relpath"], "left_anti")


def stale_large(entries: DataFrame, least: int, before_ns: int) -> DataFrame:
    return entries.filter(_file() & (F.col("size") >= least) & (F.col("mtime_ns") < before_ns)).select("root", "relpath", "size", "mtime_ns")


def numbering(entries: DataFrame) -> DataFrame:
    """Per folder with two or more numbered files: doubled and missing numbers, and whether widths differ."""
    n = N.number_prefix(P.basename(F.col("relpath")))
    held = entries.filter(_file()).select("root", P.parent(F.col("relpath")).alias("dir"), n.alias("t")).filter("t <> ''").withColumn("n", F.col("t").cast("int"))
    per = held.groupBy("root", "dir").agg(F.count(F.lit(1)).alias("files"), F.collect_set("n").alias("ns"), F.countDistinct(F.length("t")).alias("widths"))
    gaps = F.size(F.array_except(F.sequence(F.array_min("ns"), F.array_max("ns")), "ns"))
    return per.filter("files >= 2").select("root", "dir", "files", (F.col("files") - F.size("ns")).alias("doubled"), gaps.cast("long").alias("missing"), "widths")


def similar_siblings(entries: DataFrame) -> DataFrame:
    """Folders side by side with the same skeleton and the same digits: root, dir (theirs), skeleton, digits, folders, first_name, size (all below them)."""
    folders = _folders(entries).filter("dir <> ''").select("root", "dir")
    held = folders.select("root", F.col("dir").alias("path"), P.parent(F.col("dir")).alias("dir"), P.basename(F.col("dir")).alias("name"))
    held = held.withColumn("f", nfkc_casefold("name")).withColumn("skeleton", N.skeleton(F.col("f"))).withColumn("digits", F.regexp_replace("f", r"(?U)\D", ""))
    held = held.filter(F.length("skeleton") >= 2).join(subtree_sizes(entries).select("root", F.col("dir").alias("path"), "bytes"), ["root", "path"], "left")
    per = held.groupBy("root", "dir", "skeleton", "digits").agg(F.count(F.lit(1)).alias("folders"), F.min("name").alias("first_name"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"))
    return per.filter("folders >= 2")


def mixed_dates(entries: DataFrame) -> DataFrame:
    """Folders whose files use more than one date format."""
    held = entries.filter(_file()).select("root", P.parent(F.col("relpath")).alias("dir"), N.date_format(P.basename(F.col("relpath"))).alias("f")).filter("f IS NOT NULL")
    per = held.groupBy("root", "dir").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_set("f")).alias("fs"))
    return per.filter(F.size("fs") > 1).select("root", "dir", "files", F.array_join("fs", ",").alias("formats"))


def mixed_kinds(entries: DataFrame, least: int = 30, share: float = 0.15) -> DataFrame:
    """Folders with ``least`` files of known kinds of which three or more kinds have a share each."""
    k = N.kind(F.col("relpath"))
    k = F.when(k.isin("pdf", "office", "text"), "document").otherwise(k)
    per = entries.filter(_file()).select("root", P.parent(F.col("relpath")).alias("dir"), k.alias("kind")).groupBy("root", "dir", "kind").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("root", "dir"))
    big = per.withColumn("files", total).filter((F.col("files") >= least) & F.col("kind").isNotNull() & (F.col("n") >= share * F.col("files")))
    return big.groupBy("root", "dir").agg(F.max("files").alias("files"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.count(F.lit(1)).alias("k")).filter("k >= 3").drop("k")


def identical_members(entries: DataFrame, least: int = 2) -> DataFrame:
    """Identical folders as rows: root, files, s1, s2 (their signature), dir, bytes.

    All files below such a folder are hashed, and they hold the same contents
    at the same relative paths. A signature is an order-free sum of the files'
    hashes, so no folder's files are gathered in one place; equal signatures of
    2 x 64 bits and equal counts mean the same multiset. A folder that lies
    above or below another one of its group is left out.
    """
    p = F.col("relpath")
    files = entries.filter(_file()).select("root", "relpath", "size", F.when(current_hash(), F.col("sha256")).alias("h"))
    up = files.select("root", "relpath", "size", "h", F.explode(P.ancestors(p)).alias("dir")).filter("dir <> ''")
    rel = F.substring(F.col("relpath"), F.length("dir") + 2, F.length("relpath"))
    sig = [F.sum(F.xxhash64(rel, F.col("h"), F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    per = up.groupBy("root", "dir").agg(F.count(F.lit(1)).alias("files"), F.count("h").alias("hashed"), F.sum("size").alias("bytes"), *sig).filter((F.col("files") >= least) & (F.col("files") == F.col("hashed")))
    key = ["root", "files", "s1", "s2"]

    def shared(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy(*key).count().filter("count > 1").select(*key), key, "left_semi")

    held = _cut(shared(per).select(*key, "dir", "bytes"))
    nested = held.select(*key, "dir", F.explode(P.ancestors(F.col("dir"))).alias("up")).join(held.select(*key, F.col("dir").alias("up")), [*key, "up"])
    inside = nested.select(*key, "dir").union(nested.select(*key, F.col("up"))).distinct()
    return _cut(shared(held.join(inside, [*key, "dir"], "left_anti")))


def identical_folders(entries: DataFrame, least: int = 2) -> DataFrame:
    """Groups of identical folders that need a look: root, path (the first), files, folders, more, size (what copies take).

    A group whose folders all lie directly in folders of other groups is
    explained by those. Groups that differ in the same places (what is left of
    their paths without the part that all have at the end) are one row, that of
    the group with most files; ``more`` counts the others.
    """
    held = identical_members(entries, least)
    key = ["root", "files", "s1", "s2"]
    known = held.select("root", F.col("dir").alias("parent")).distinct().withColumn("known", F.lit(True))
    seen = held.withColumn("parent", P.parent(F.col("dir"))).join(known, ["root", "parent"], "left")
    parts = F.reverse(P.parts(F.col("dir")))
    groups = seen.groupBy(*key).agg(F.count("known").alias("known"), F.count(F.lit(1)).alias("folders"), F.min(F.struct("dir", "bytes")).alias("f"), F.min(parts).alias("lo"), F.max(parts).alias("hi"), F.min(F.size(parts)).alias("least"))
    # what the first and the last of the reversed paths have in common, all have
    same = F.aggregate(F.sequence(F.lit(0), F.col("least") - 1), F.lit(0), lambda n, i: F.when((n == i) & (i < F.col("least") - 1) & (F.get("lo", i) == F.get("hi", i)), i + 1).otherwise(n))
    groups = groups.filter("known < folders").withColumn("common", same)
    origin = held.join(groups.select(*key, "common"), key).withColumn("origin", F.array_join(F.slice(P.parts(F.col("dir")), F.lit(1), F.size(P.parts(F.col("dir"))) - F.col("common")), "/"))
    places = origin.groupBy(*key).agg(*[F.sum(F.xxhash64("origin", F.lit(i)).cast("decimal(38,0)")).alias(f"o{i}") for i in (1, 2)])
    ranked = groups.join(places, key).withColumn("rank", F.struct(-F.col("files"), F.col("f.dir")))
    best = F.min_by(F.struct("f", "files", "folders"), "rank")
    one = ranked.groupBy("root", "folders", "o1", "o2").agg(best.alias("b"), (F.count(F.lit(1)) - 1).alias("more"))
    return one.select("root", F.col("b.f.dir").alias("path"), F.col("b.files").alias("files"), F.col("b.folders").alias("folders"), "more", (F.col("b.f.bytes") * (F.col("b.folders") - 1)).alias("size"))
