"""Clean-up plans as tables: built from findings, validated against observations, followed in journals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import name_key


def fingerprints(paths: DataFrame, observed: DataFrame) -> DataFrame:
    """(root, path, n_inode, n_files, n_size, n_mtime) of the ``paths`` (root, path) that are there.

    A file has its own values; a folder the count and size of the files below
    it and the newest time of it and of all below. Folders may be listed or
    only follow from what they hold.
    """
    paths = paths.select("root", "path").distinct()
    columns = {c: (F.col(c) if c in observed.columns else F.lit(None).cast("long")).alias(c) for c in ("inode", "size", "mtime_ns")}
    rows = observed.select("root", "relpath", "is_dir", *columns.values())
    own = rows.withColumnRenamed("relpath", "path").join(paths, ["root", "path"], "left_semi").withColumn("self", F.lit(True))
    below = rows.select("root", F.explode(P.ancestors(F.col("relpath"))).alias("path"), "is_dir", "inode", "size", "mtime_ns").join(paths, ["root", "path"], "left_semi").withColumn("self", F.lit(False))
    file = ~F.col("is_dir")
    return own.unionByName(below).groupBy("root", "path").agg(
        F.max(F.when(F.col("self"), F.col("inode"))).alias("n_inode"),
        F.count(F.when(file, 1)).alias("n_files"),
        F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("n_size"),
        F.max("mtime_ns").alias("n_mtime"),
    )


def _unmet(ops: DataFrame, observed: DataFrame) -> DataFrame:
    """``ops`` with ``unmet``: what has become of the file that an operation relies on (null: nothing, or it relies on none)."""
    now = observed.select("root", F.col("relpath").alias("requires"), F.col("size").alias("r_size"), F.col("mtime_ns").alias("r_mtime"), F.lit(True).alias("r_there"))
    gone = F.when(F.col("r_there").isNull(), "prerequisite missing")
    gone = gone.when((F.col("requires_size") >= 0) & ~(F.col("r_size").eqNullSafe(F.col("requires_size")) & F.col("r_mtime").eqNullSafe(F.col("requires_mtime_ns"))), "prerequisite changed")
    return ops.join(now, ["root", "requires"], "left").withColumn("unmet", F.when(F.col("requires").isNotNull(), gone)).select(*ops.columns, "unmet")


def _held(paths: DataFrame, others: DataFrame | None) -> DataFrame:
    """(root, path, held) of the ``paths`` below which something stands that the listing leaves out (others: root, relpath)."""
    if others is None:
        return paths.select("root", "path").limit(0).withColumn("held", F.lit(True))
    up = others.select("root", F.explode(P.ancestors(F.col("relpath"))).alias("path")).distinct()
    return up.join(paths.select("root", "path").distinct(), ["root", "path"], "left_semi").withColumn("held", F.lit(True))


def build(
    findings: DataFrame, entries: DataFrame, categories: list[str] | None = None, reviews: bool = False, requires: DataFrame | None = None, now: DataFrame | None = None, others: DataFrame | None = None
) -> DataFrame:
    """Plan operations: each finding with the fingerprint of what it names now and what it relies on.

    ``requires``: root, relpath, requires, requires_size, requires_mtime_ns
    (see ``hygiene.required``). ``now``: a listing made after the scan
    ``entries``; ``others``: what a listing leaves out (excluded, unreadable or
    special files). Left out are findings of vanished paths, files that
    changed since the scan, operations whose prerequisite is gone or changed,
    and empty folders that hold something unlisted.
    """
    held = findings if reviews else findings.filter("NOT needs_review")
    if categories:
        held = held.filter(F.col("category").isin(categories))
    ops = held.select("root", F.lit("quarantine").alias("action"), F.col("relpath").alias("path"), "is_dir", "category")
    seen = now if now is not None else entries
    ops = ops.join(fingerprints(ops, seen), ["root", "path"])
    if now is not None:
        then = entries.filter("NOT is_dir").select("root", F.col("relpath").alias("path"), F.col("size").alias("s"), F.col("mtime_ns").alias("m"))
        ops = ops.join(then, ["root", "path"], "left").filter(F.col("is_dir") | F.col("m").isNull() | ((F.col("s") == F.col("n_size")) & (F.col("m") == F.col("n_mtime")))).drop("s", "m")
    kinds = {"requires": "string", "requires_size": "long", "requires_mtime_ns": "long"}
    if requires is None:
        ops = ops.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    else:
        ops = ops.join(requires.select("root", F.col("relpath").alias("path"), *kinds), ["root", "path"], "left")
        ops = _unmet(ops, seen).filter("unmet IS NULL").drop("unmet")
    ops = ops.join(_held(ops.filter("category = 'empty-dir'"), others), ["root", "path"], "left").filter("held IS NULL OR category <> 'empty-dir'")
    return ops.select("root", "action", "path", "is_dir", F.col("n_files").alias("files"), F.col("n_size").alias("size"), F.col("n_mtime").alias("mtime_ns"), F.col("n_inode").alias("inode"), "category", *kinds)


def case_clashes(moves: DataFrame, observed: DataFrame) -> DataFrame:
    """(root, path, dest, clash): where a destination, or a folder on its way, differs from something there only by case or normal form.

    What is moved, and the folders above it, don't count, so a change of case
    alone is allowed. Beyond the first folder that isn't there yet nothing can
    clash. Names are compared only in folders on the way of a destination.
    """
    p = F.col("relpath")
    there = observed.select("root", "relpath").unionByName(observed.select("root", F.explode(P.ancestors(p)).alias("relpath")).filter("relpath <> ''")).distinct()
    way = moves.select("root", "path", "dest", F.explode(F.filter(P.self_and_ancestors(F.col("dest")), lambda x: x != "")).alias("step"))
    way = way.withColumn("parent", P.parent(F.col("step"))).withColumn("key", name_key(P.basename(F.col("step"))))
    kids = there.withColumn("parent", P.parent(p)).join(way.select("root", "parent").distinct(), ["root", "parent"], "left_semi")
    kids = kids.select("root", "parent", F.col("relpath").alias("other"), name_key(P.basename(p)).alias("key"))
    hit = way.join(kids, ["root", "parent", "key"]).filter((F.col("other") != F.col("step")) & (F.col("other") != F.col("path")) & ~F.col("path").startswith(F.concat(F.col("other"), F.lit("/"))))
    parents = there.select("root", F.col("relpath").alias("parent"))
    reached = hit.filter("parent = ''").unionByName(hit.join(parents, ["root", "parent"], "left_semi").select(*hit.columns))
    return reached.groupBy("root", "path", "dest").agg(F.min_by("other", F.struct(F.length("step"), "other")).alias("clash"))


def check(ops: DataFrame, observed: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Each operation's first ``problem``, null if it can run: missing, replaced, changed, not empty, prerequisite missing,
    prerequisite changed, destination exists, case clash.

    ops: root, path, is_dir, size, mtime_ns, and where they apply inode, files,
    dest (null: not a move), category, requires, requires_size and
    requires_mtime_ns; observed: root, relpath, is_dir, inode, size, mtime_ns.
    A folder is compared by what stands below it. ``others`` as in ``build``.
    """
    kinds = {"inode": "long", "files": "long", "dest": "string", "category": "string", "requires": "string", "requires_size": "long", "requires_mtime_ns": "long"}
    held = ops.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in ops.columns])
    held = _unmet(held, observed)
    now = fingerprints(held, observed).withColumn("there", F.lit(True))
    p = F.col("relpath")
    there = observed.select("root", p.alias("dest")).unionByName(observed.select("root", F.explode(P.ancestors(p)).alias("dest"))).join(held.select("root", "dest").distinct(), ["root", "dest"], "left_semi").distinct().withColumn("taken", F.lit(True))
    clash = case_clashes(held.filter("dest IS NOT NULL").select("root", "path", "dest").distinct(), observed)
    held = held.join(now, ["root", "path"], "left").join(_held(held.filter("category = 'empty-dir' AND is_dir"), others), ["root", "path"], "left").join(there, ["root", "dest"], "left").join(clash, ["root", "path", "dest"], "left")
    count = F.coalesce("files", F.when(~F.col("is_dir"), F.lit(1)), F.col("n_files"))
    problem = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("inode") != F.col("n_inode"), "replaced")
        .when((count != F.col("n_files")) | (F.col("size") != F.col("n_size")) | (F.col("mtime_ns") != F.col("n_mtime")), "changed")
        .when((F.col("category") == "empty-dir") & F.col("is_dir") & (F.col("held") | (F.col("n_files") > 0)), "not empty")
        .when(F.col("unmet").isNotNull(), F.col("unmet"))
        .when(F.col("taken"), "destination exists")
        .when(F.col("clash").isNotNull(), "case clash")
    )
    return held.withColumn("problem", problem).select(*ops.columns, "problem")


def path_problem(path, dest):
    """Why a move is unsafe: absolute, empty or dot parts, or a destination at or below the source."""
    bad = F.exists(P.parts(dest), lambda p: p.isin("", ".", ".."))
    return F.when(dest.startswith("/"), "absolute").when(bad, "bad part").when((dest == path) | dest.startswith(F.concat(path, F.lit("/"))), "into itself")


def normalized_batch(moves: DataFrame) -> DataFrame:
    """A batch of moves (root, path, dest) without paths below other selected ones and without no-op moves, with ``clash`` where a destination is named twice."""
    up = moves.select("root", "path", F.explode(P.ancestors(F.col("path"))).alias("up"))
    below = up.join(moves.select("root", F.col("path").alias("up")), ["root", "up"], "left_semi").select("root", "path").distinct()
    held = moves.join(below, ["root", "path"], "left_anti").filter("path <> dest")
    return held.withColumn("clash", F.count(F.lit(1)).over(W.partitionBy("root", name_key(F.col("dest")))) > 1)


def pending_restores(journal: DataFrame) -> DataFrame:
    """(plan_id, path, event, size, began, undo): what a plan has put aside or moved and not put back, in the order of undoing (1, 2, ...).

    A path counts from when it was moved after it was last put back or purged;
    a path that is moved twice keeps its place in the order.
    """
    size = F.col("size") if "size" in journal.columns else F.lit(0).cast("long")
    acts = journal.filter(F.col("event").isin("quarantine", "move", "restore", "purge")).select("plan_id", "path", "seq", "event", size.alias("size"))
    back = F.col("event").isin("restore", "purge")
    settled = acts.filter(back).groupBy("plan_id", "path").agg(F.max("seq").alias("settled"))
    held = acts.filter(~back).join(settled, ["plan_id", "path"], "left").filter("settled IS NULL OR seq > settled")
    held = held.groupBy("plan_id", "path").agg(F.max_by("event", "seq").alias("event"), F.max_by("size", "seq").alias("size"), F.min("seq").alias("began"))
    return held.withColumn("undo", F.row_number().over(W.partitionBy("plan_id").orderBy(F.desc("began"))))


def journal_state(journal: DataFrame) -> DataFrame:
    """Per plan: state, pending and pending_size (what is put aside or moved and not put back).

    journal: plan_id, seq, event, path, size; events: apply, quarantine, move,
    finish, abort, restore, purge. States in this order: draft (never applied,
    or the last run was aborted before it did anything), interrupted (no finish
    after the last apply), purged (and nothing pending), undone and
    partially-undone (something was ever restored), applied.
    """
    is_ = lambda *e: F.col("event").isin(*e)
    last = W.partitionBy("plan_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = journal.withColumn("run", F.max(F.when(is_("apply"), F.col("seq"))).over(last))
    runs = marked.groupBy("plan_id", "run").agg(
        F.min(F.when(is_("quarantine", "move"), F.col("seq"))).alias("acted"),
        F.min(F.when(is_("abort"), F.col("seq"))).alias("aborted"),
        F.max(is_("finish")).alias("finished"),
        F.max(is_("restore")).alias("restored"),
        F.max(is_("purge")).alias("purged"),
    )
    plans = runs.groupBy("plan_id").agg(F.max("run").alias("run"), F.max_by(F.struct("acted", "aborted", "finished"), F.coalesce("run", F.lit(-(2**62)))).alias("last"), F.max("restored").alias("restored"), F.max("purged").alias("purged"))
    pending = pending_restores(journal).groupBy("plan_id").agg(F.count(F.lit(1)).alias("pending"), F.coalesce(F.sum("size"), F.lit(0)).alias("pending_size"))
    out = plans.join(pending, "plan_id", "left").fillna(0, ["pending", "pending_size"])
    nothing = F.col("last.aborted").isNotNull() & (F.col("last.acted").isNull() | (F.col("last.aborted") < F.col("last.acted")))
    state = (
        F.when(F.col("run").isNull() | nothing, "draft")
        .when(~F.col("last.finished"), "interrupted")
        .when(F.col("purged") & (F.col("pending") == 0), "purged")
        .when(F.col("restored"), F.when(F.col("pending") > 0, "partially-undone").otherwise("undone"))
        .otherwise("applied")
    )
    return out.select("plan_id", state.alias("state"), "pending", "pending_size")


def sync_paused(journal: DataFrame) -> DataFrame:
    """(plan_id, detail) of the plans that have paused a sync and not resumed it, with the last error since ('' if none)."""
    held = journal.filter(F.col("event").isin("sync-pause", "sync-resume")).groupBy("plan_id").agg(F.max_by("event", "seq").alias("last"), F.max("seq").alias("since")).filter("last = 'sync-pause'")
    errors = journal.filter("event = 'sync-error'").join(held.select("plan_id", "since"), "plan_id").filter("seq > since").groupBy("plan_id").agg(F.max_by("detail", "seq").alias("detail"))
    return held.join(errors, "plan_id", "left").select("plan_id", F.coalesce("detail", F.lit("")).alias("detail"))
