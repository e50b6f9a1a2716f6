"""Suggestions, decisions and plans as tables: lookups, post-processing, logging, routing and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P


def suggestion_lookup(contents: DataFrame, suggestions: DataFrame, model: str, fallback: str, version: int) -> DataFrame:
    """(sha256, model, dest): each content's newest suggestion of ``model`` at the prompt version, else that of ``fallback``."""
    held = suggestions.filter((F.col("prompt_version") == version) & F.col("model").isin(model, fallback))
    newest = held.groupBy("sha256", "model").agg(F.max_by("dest", F.struct("created_at", "dest")).alias("dest"))
    first, second = (newest.filter(F.col("model") == m).select("sha256", F.col("dest").alias(c)) for m, c in ((model, "a"), (fallback, "b")))
    out = contents.select("sha256").join(first, "sha256", "left").join(second, "sha256", "left").filter("a IS NOT NULL OR b IS NOT NULL")
    return out.select("sha256", F.when(F.col("a").isNotNull(), model).otherwise(fallback).alias("model"), F.coalesce("a", "b").alias("dest"))


def picked_destinations(answers: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """(id, rank, dest): an answer's indices (from 1) into its candidates (id, n, dest) in their order: unknown ones dropped, each destination once."""
    each = answers.select("id", F.posexplode("picks").alias("pos", "n")).join(candidates, ["id", "n"])
    once = each.groupBy("id", "dest").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("pos"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).select("id", "rank", "dest")


def destination_candidates(examples: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """(id, n, dest): destinations of past examples first, then index hits, each once, ``most`` of them; both sides: id, rank, dest."""
    both = examples.withColumn("part", F.lit(0)).unionByName(hits.withColumn("part", F.lit(1)))
    once = both.groupBy("id", "dest").agg(F.min(F.struct("part", "rank")).alias("at"))
    n = F.row_number().over(W.partitionBy("id").orderBy("at", "dest"))
    return once.withColumn("n", n).filter(F.col("n") <= most).select("id", "n", "dest")


def decision_examples(decisions: DataFrame, reverted: DataFrame) -> DataFrame:
    """(sha256, path, dest): the last accepted decision of each content, without those of reverted plans; decisions: seq, sha256, path, dest, decision, plan_id."""
    held = decisions.filter("decision = 'accept'").join(reverted, "plan_id", "left_anti")
    return held.groupBy("sha256").agg(F.max_by(F.struct("path", "dest"), "seq").alias("v")).select("sha256", "v.*")


def rejected_tags(decisions: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """(tag, rejects): tags that were rejected ``least`` times or more, the most rejected ones."""
    per = decisions.filter("decision = 'reject'").groupBy("tag").agg(F.count(F.lit(1)).alias("rejects"))
    return per.filter(F.col("rejects") >= least).orderBy(F.desc("rejects"), "tag").limit(most)


def logged_decisions(ops: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Executed operations (path, sha256, dest, plan_id) beside what was suggested for their content: decision accept, changed or manual."""
    held = suggestions.select("sha256", "model", F.col("dest").alias("suggested"))
    how = F.when(F.col("suggested").isNull(), "manual").when(F.col("suggested") == F.col("dest"), "accept").otherwise("changed")
    return ops.join(held, "sha256", "left").select("plan_id", "path", "sha256", "model", "suggested", "dest", how.alias("decision"))


def accepted_events(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Tag and attribute events of accepted answers (root, path, tags, name, kind, value), and one definition for each attribute that ``known`` (name) lacks."""
    nothing = F.lit(None).cast("string")
    tags = answers.select(F.lit("add").alias("op"), "root", "path", F.explode("tags").alias("tag"), nothing.alias("name"), nothing.alias("value"), F.lit("ai").alias("source"))
    attrs = answers.filter("value IS NOT NULL").select(F.lit("attr-set"), "root", "path", nothing, "name", "value", F.lit("ai"))
    define = answers.filter("value IS NOT NULL").select("name", "kind").distinct().join(known, "name", "left_anti")
    return tags.union(attrs).union(define.select(F.lit("attr-def"), nothing, nothing, nothing, "name", F.col("kind"), F.lit("ai")))


def model_routes(roots: DataFrame, models: list[tuple[str, bool]]) -> DataFrame:
    """(root, model, error): which models a root's contents may go to; models: name, whether it is in a cloud; roots: root, allow_cloud."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("cloud")) for m, c in models]))
    return roots.select("root", "allow_cloud", each.alias("m")).select("root", "m.model", F.when(F.col("m.cloud") & ~F.col("allow_cloud"), "cloud not allowed").alias("error"))


def plan_summary(ops: DataFrame, state: DataFrame, skipped: DataFrame) -> DataFrame:
    """(plan_id, ops, run, bytes, state): operations of each plan, those not in ``skipped`` (plan_id, path), and its journal's state."""
    marked = ops.join(skipped.withColumn("skip", F.lit(True)), ["plan_id", "path"], "left")
    live = F.col("skip").isNull()
    per = marked.groupBy("plan_id").agg(F.count(F.lit(1)).alias("ops"), F.count(F.when(live, 1)).alias("run"), F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("bytes"))
    return per.join(state.select("plan_id", "state"), "plan_id", "left").fillna("draft", ["state"])


def model_evaluation(runs: DataFrame) -> DataFrame:
    """Per model: answers, failures, mean seconds and tokens; runs: model, error, seconds, tokens."""
    good = F.col("error").isNull()
    return runs.groupBy("model").agg(F.count(F.when(good, 1)).alias("ok"), F.count(F.when(~good, 1)).alias("failed"), F.avg(F.when(good, F.col("seconds"))).alias("seconds"), F.avg(F.when(good, F.col("tokens"))).alias("tokens"))


def import_counts(incoming: DataFrame, current: DataFrame, ops: list[str]) -> DataFrame:
    """(op, added, known, invalid): what an import adds; events (op, root, path, tag) of unknown ops are invalid, facts that stand are known."""
    ok = F.col("op").isin(ops)
    facts = current.select("root", "path", "tag").distinct().withColumn("here", F.lit(True))
    held = incoming.distinct().join(facts, ["root", "path", "tag"], "left")
    here = F.col("here").isNotNull() & (F.col("op") == "add")
    return held.groupBy("op").agg(F.count(F.when(ok & ~here, 1)).alias("added"), F.count(F.when(ok & here, 1)).alias("known"), F.count(F.when(~ok, 1)).alias("invalid"))


def refresh_due(timings: DataFrame, now: Column, interval: int, back_off: int = 600) -> DataFrame:
    """(root, due): scanned once, sync idle, the interval over or a sync ended after the scan, and no failure within ``back_off`` seconds."""
    fresh = (now - F.col("scanned_at") >= interval) | (F.coalesce("sync_ended_at", F.lit(0)) > F.col("scanned_at"))
    calm = F.col("failed_at").isNull() | (now - F.col("failed_at") >= back_off)
    return timings.select("root", (F.col("scanned_at").isNotNull() & ~F.col("sync_busy") & F.coalesce(fresh, F.lit(False)) & calm).alias("due"))


def digest(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, key, value): small aggregates (key, value) as one table."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.col("key").cast("string").alias("key"), F.col("value").cast("long").alias("value"))
        out = part if out is None else out.union(part)
    return out


# Folders whose whole name is a date (year and month in three forms, a year in two), and what they become.
DATED = [(r"^(19|20)[0-9]{2}年[0-9]{1,2}月$", "y年m月"), (r"^(19|20)[0-9]{2}-[0-9]{2}$", "y-m"), (r"^(19|20)[0-9]{4}$", "ym"), (r"^(19|20)[0-9]{2}年$", "y年"), (r"^(19|20)[0-9]{2}$", "y")]


def dated_destinations(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted`` (root, dest, date as yyyymmdd) with ``adjusted`` and ``note`` ('', ``moved`` or ``new``).

    Folders of the destination that are named by a year or a month take the
    date's. The result counts if that folder is known (root, dir): ``moved``,
    or if the folder above it is, or is the root: ``new``; else the destination
    stays as it was, as it does without a date.
    """
    year, month = F.substring("date", 1, 4), F.substring("date", 5, 2)

    def part(p):
        out = None
        for pattern, form in DATED:
            name = F.concat(*[year if c == "y" else month if c == "m" else F.lit(c) for c in form])
            out = F.when(p.rlike(pattern), name) if out is None else out.when(p.rlike(pattern), name)
        return out.otherwise(p)

    rows = wanted.withColumn("__new", F.when(F.coalesce("date", F.lit("")) != "", F.array_join(F.transform(P.parts(F.col("dest")), part), "/")).otherwise(F.col("dest")))
    rows = rows.withColumn("__up", P.parent(F.col("__new")))
    there = known.select("root", F.col("dir").alias("__new")).distinct().withColumn("__there", F.lit(True))
    above = known.select("root", F.col("dir").alias("__up")).distinct().withColumn("__above", F.lit(True))
    held = rows.join(there, ["root", "__new"], "left").join(above, ["root", "__up"], "left")
    note = F.when(F.col("__new") == F.col("dest"), "").when(F.col("__there"), "moved").when(F.col("__above") | (F.col("__up") == ""), "new").otherwise("")
    return held.withColumn("note", note).withColumn("adjusted", F.when(note != "", F.col("__new")).otherwise(F.col("dest"))).select(*wanted.columns, "adjusted", "note")
