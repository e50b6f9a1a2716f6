"""State that follows a stream: tags of a growing log, reflected deletions, scans, snapshot alerts.

Each operator keeps its state as a table of versions, one for each batch: a
batch reads the version before it and writes its own, so a batch that is
repeated after a failure replaces what it wrote and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fold as G
from ..operators import inventory as I
from ..sources import logs as L
from ..sources.shared import cut

# How two sync clients report a deleted path.
DELETED = [r"Deleting item from Microsoft OneDrive: (?:\./)?(.+?)\s*$", r"INFO\s+: (.+): Deleted\s*$"]
#: Alerts that a root keeps.
KEPT = 20


class Versions:
    """A table of versions below ``path``: the version of batch n stands in v=n."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def before(self, batch: int | None = None) -> DataFrame:
        """The last version, or the last one before ``batch``."""
        try:
            every = self.spark.read.schema(f"{self.schema}, v LONG").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        held = every if batch is None else every.filter(F.col("v") < batch)
        last = held.agg(F.max("v")).first()[0]
        return held.filter(F.col("v") == last).drop("v") if last is not None else held.limit(0).drop("v")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v={batch}")


EVENTS = ", ".join(f"{c} {t}" for c, t in G.COLUMNS.items() if c != "seq") + ", at string, file string, line long"
#: Kinds of events that concern all roots.
GENERAL = ["rename", "delete", "alias", "unalias", "attr-undef"]


def live_facts(stream: DataFrame, path: str, checkpoint: str, table: str = "items", **trigger) -> StreamingQuery:
    """Keeps ``table`` of the fold (see ``fold.fold``) up to date with a stream of events, in ``path``/state, partitioned by root.

    Events (columns of ``EVENTS``; what is missing is null) may come late and
    from many writers: their order is that of (at, file, line), and roots with
    new events are folded anew from all their events, others are left as they
    are. An event of a general kind concerns every root. A batch writes its
    events under its own number, and the partitions of the roots it touches
    replace what was there, so a repeated batch has no effect.
    """
    columns = [c.split()[0] for c in EVENTS.split(", ")]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kinds = dict(x.split(" ", 1) for x in EVENTS.split(", "))
        batch.select(*[(F.col(c) if c in batch.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]).write.mode("overwrite").parquet(f"{path}/events/v={number}")
        every = spark.read.schema(f"{EVENTS}, v LONG").parquet(f"{path}/events").drop("v")
        new = spark.read.schema(EVENTS).parquet(f"{path}/events/v={number}")
        general = F.col("op").isin(GENERAL)
        if new.filter(general).isEmpty():
            touched = cut(new.filter("root IS NOT NULL").select("root").distinct())
            every = every.filter(general).unionByName(every.filter(~general).join(touched, "root", "left_semi").select(*columns))
        else:
            touched = cut(every.filter("root IS NOT NULL").select("root").distinct())
        if touched.isEmpty():
            return
        ordered = L.numbered(every, [F.coalesce("at", F.lit("")), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0))])
        facts = G.fold(ordered, [table])[table]
        marks = touched.select(*[(F.col(c) if c == "root" else F.lit(None).cast(t)).alias(c) for c, t in facts.dtypes])  # so that a root without facts is replaced too
        facts.unionByName(marks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root").parquet(f"{path}/state")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_state(spark: SparkSession, path: str) -> DataFrame:
    """The facts that ``live_facts`` keeps."""
    rows = spark.read.parquet(f"{path}/state")
    first = next(c for c in rows.columns if c != "root")
    return rows.filter(F.col(first).isNotNull())


def deleted_paths(lines: DataFrame) -> DataFrame:
    """``lines`` (root, line) that report a deletion, with its path."""
    found = F.coalesce(*[F.when(F.regexp_extract("line", p, 1) != "", F.regexp_extract("line", p, 1)) for p in DELETED])
    return lines.withColumn("path", found).filter("path IS NOT NULL")


def reflected(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """(root, path) of the ``expected`` deletions (root, path) that log lines report, each once; as a batch, or as a stream against a table."""
    return deleted_paths(lines).join(expected.select("root", "path").distinct(), ["root", "path"], "left_semi").select("root", "path").dropDuplicates(["root", "path"])


def still_expected(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """The expected deletions that no line has reported."""
    return expected.join(reflected(lines, expected), ["root", "path"], "left_anti")


def _whole(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tail, n = state.get if state.exists else ("", 0)
    rows = pd.concat(list(frames)).sort_values("chunk")
    *done, tail = (tail + "".join(rows["text"])).split("\n")
    state.update((tail, n + len(done)))
    yield pd.DataFrame({"root": [key[0]] * len(done), "line_no": range(n, n + len(done)), "line": [x.removesuffix("\r") for x in done]})


def whole_lines(chunks: DataFrame) -> DataFrame:
    """A stream of (root, line_no, line) from one of pieces of logs (root, chunk, text): what follows the last newline waits for the next piece.

    The pieces of a root within one batch are joined in order; a batch should
    hold as much of a log as one task can read.
    """
    return chunks.groupBy("root").applyInPandasWithState(_whole, "root string, line_no long, line string", "tail string, n long", "append", GroupStateTimeout.NoTimeout)


ENTRIES = "root string, relpath string, is_dir boolean, size long, mtime_ns long, inode long, first_seen long, last_seen long, missing_count int, gone_at long, gone_by string"


def scan_step(entries: DataFrame, observed: DataFrame, now: int, least: int = 100, ratio: float = 0.2, accept_missing: bool = False) -> DataFrame:
    """The catalog (``ENTRIES``) after one more scan of the roots that ``observed`` lists: root, relpath, is_dir, size, mtime_ns, inode.

    What was seen isn't missing any more; moved entries (by inode) keep their
    row. If more files of a root are missing than max(least, int(live *
    ratio)), only those that were missing in its last scan too are gone; the
    others are held and counted as missing once more. Otherwise, or with
    ``accept_missing``, all that is missing is gone. A root without any
    observation is left alone: it wasn't available.
    """
    roots = observed.select("root").distinct()
    live = entries.filter("gone_at IS NULL").join(roots, "root", "left_semi")
    rest = entries.filter("gone_at IS NOT NULL").unionByName(entries.filter("gone_at IS NULL").join(roots, "root", "left_anti"))
    changes = cut(I.diff(live, observed))
    pairs = cut(I.inode_pairs(changes))
    moved = changes.join(pairs.select("root", F.col("new_relpath").alias("relpath"), "old_relpath"), ["root", "relpath"], "left")
    history = live.select("root", F.col("relpath").alias("was"), "first_seen")
    seen = moved.filter("state <> 'missing'").withColumn("was", F.coalesce("old_relpath", "relpath")).join(history, ["root", "was"], "left")
    known = F.col("state") != "same"  # an unreadable place keeps what was known of it
    kept = [F.when(known | F.col(n).isNotNull(), F.col(n)).otherwise(F.col(o)).alias(n) for n, o in (("is_dir", "o_dir"), ("size", "o_size"), ("mtime_ns", "o_mtime"), ("inode", "o_inode"))]
    tail = [F.lit(now).cast("long").alias("last_seen"), F.lit(0).alias("missing_count"), F.lit(None).cast("long").alias("gone_at"), F.lit(None).cast("string").alias("gone_by")]
    there = seen.select("root", "relpath", *kept, F.coalesce("first_seen", F.lit(now)).cast("long").alias("first_seen"), *tail)
    missing = live.join(changes.filter("state = 'missing'").select("root", "relpath"), ["root", "relpath"], "left_semi").join(pairs.select("root", F.col("old_relpath").alias("relpath")), ["root", "relpath"], "left_anti")
    files = lambda df, name: df.filter("NOT is_dir").groupBy("root").agg(F.count(F.lit(1)).alias(name))
    mass = files(live, "files").join(files(missing, "lost"), "root", "left").select("root", (F.col("lost") > F.greatest(F.lit(least), F.floor(F.col("files") * ratio))).alias("mass"))
    missing = missing.join(mass, "root", "left")
    held = F.coalesce("mass", F.lit(False)) & (F.col("missing_count") < 1) & F.lit(not accept_missing)
    lost = missing.select("root", "relpath", "is_dir", "size", "mtime_ns", "inode", "first_seen", "last_seen", F.when(held, F.col("missing_count") + 1).otherwise(F.col("missing_count")).cast("int").alias("missing_count"), F.when(~held, F.lit(now)).cast("long").alias("gone_at"), F.when(~held, F.lit("scan")).alias("gone_by"))
    return rest.unionByName(there).unionByName(lost)


def live_catalog(stream: DataFrame, path: str, checkpoint: str, least: int = 100, ratio: float = 0.2, accept: frozenset[int] = frozenset(), **trigger) -> StreamingQuery:
    """Applies each scan of a stream (scan, root, relpath, is_dir, size, mtime_ns, inode; ``scan`` is its time) to the catalog in ``path``, scan by scan.

    ``accept``: scans whose missing files are all accepted as gone. The rows of
    a scan have to come in one batch (one file a scan is enough for that).
    """

    def step(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, path, ENTRIES)
        now, rows = table.before(number), cut(batch)
        for (scan,) in sorted(rows.select("scan").distinct().collect()):  # a few scans a batch
            now = cut(scan_step(now, rows.filter(F.col("scan") == scan).drop("scan"), scan, least, ratio, scan in accept))
        table.write(now, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


FILES, ALERTS = "root string, taken_at long, relpath string, size long, mtime_ns long", "root string, newer long, older long, deleted long, changed long"


def watched_snapshots(stream: DataFrame, path: str, checkpoint: str, dismissed: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Compares each new snapshot listing (``FILES``) with the one before it and keeps alerts in ``path``/alerts, one for each newer snapshot.

    A root keeps its last ``KEPT`` alerts; ``dismissed`` (root, newer) don't
    come back. The last listing of each root stays in ``path``/last for the
    next batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last, alerts = Versions(spark, f"{path}/last", FILES), Versions(spark, f"{path}/alerts", ALERTS)
        files = cut(last.before(number).unionByName(batch.select(*[c.split()[0] for c in FILES.split(", ")])).distinct())
        times = files.select("root", "taken_at").distinct()
        before = times.withColumn("older", F.lag("taken_at").over(W.partitionBy("root").orderBy("taken_at"))).withColumnRenamed("taken_at", "newer")
        found = I.snapshot_diff(files).filter("alert").join(before, ["root", "newer"]).select("root", "newer", "older", "deleted", "changed")
        held = alerts.before(number)
        both = held.unionByName(found.join(held.select("root", "newer"), ["root", "newer"], "left_anti"))
        if dismissed is not None:
            both = both.join(dismissed, ["root", "newer"], "left_anti")
        newest = W.partitionBy("root").orderBy(F.desc("newer"))
        alerts.write(both.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= KEPT).drop("r"), number)
        latest = times.groupBy("root").agg(F.max("taken_at").alias("taken_at"))
        last.write(files.join(latest, ["root", "taken_at"], "left_semi").select("root", "taken_at", "relpath", "size", "mtime_ns"), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
