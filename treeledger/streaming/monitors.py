"""Streaming monitors: sync-log progress and event rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEADING = r"^run started"
PROGRESS = "entry string, runs long, copied long, deleted long, errors long, last_file string"


def classified(lines: DataFrame) -> DataFrame:
    """Log lines (entry, line_no, line) with their kind (heading, copied, deleted, error) and file."""
    line = F.col("line")
    kind = F.when(line.rlike(HEADING), "heading").when(line.rlike(r"(?i)\berror\b"), "error").when(line.rlike(": Copied"), "copied").when(line.rlike(": Deleted"), "deleted")
    return lines.withColumn("kind", kind).withColumn("file", F.when(F.col("kind").isin("copied", "deleted"), F.regexp_extract("line", r"^(?:.*INFO\s*: )?(.*?): (?:Copied|Deleted)", 1)))


def progress(lines: DataFrame) -> DataFrame:
    """The current run's counts per entry: lines from the last heading on (batch form)."""
    held = classified(lines)
    start = held.filter("kind = 'heading'").groupBy("entry").agg(F.max("line_no").alias("start"), F.count(F.lit(1)).alias("runs"))
    now = held.join(start, "entry", "left").filter("start IS NULL OR line_no >= start")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return now.groupBy("entry").agg(F.coalesce(F.max("runs"), F.lit(0)).alias("runs"), n("copied").alias("copied"), n("deleted").alias("deleted"), n("error").alias("errors"), F.max_by("file", F.when(F.col("file").isNotNull(), F.col("line_no"))).alias("last_file"))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    runs, copied, deleted, errors, last = state.get if state.exists else (0, 0, 0, 0, None)
    rows = pd.concat(list(frames)).sort_values("line_no")
    for kind, file in zip(rows["kind"], rows["file"], strict=True):
        if kind == "heading":
            runs, copied, deleted, errors, last = runs + 1, 0, 0, 0, None
        copied, deleted, errors = copied + (kind == "copied"), deleted + (kind == "deleted"), errors + (kind == "error")
        last = file if isinstance(file, str) else last
    state.update((runs, copied, deleted, errors, last))
    yield pd.DataFrame({"entry": [key[0]], "runs": [runs], "copied": [copied], "deleted": [deleted], "errors": [errors], "last_file": [last]})


def progress_stream(lines: DataFrame) -> DataFrame:
    """The same over a stream; each entry keeps its counts as state."""
    return classified(lines).groupBy("entry").applyInPandasWithState(_advance, PROGRESS, "runs long, copied long, deleted long, errors long, last string", "update", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per kind and hour; late ones count within the watermark."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "events", "total")
