"""Catalog tables that follow from the star-schema and text tables, for queries without a scanned tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_catalog(docs: DataFrame) -> DataFrame:
    """One file per document, source/lang/name; the name's form follows from doc_id, and every 31st has a conflict copy."""
    i, m = F.col("doc_id"), F.col("doc_id") % 31
    s = i.cast("string")
    name = (
        F.when(m == 0, F.concat(F.lit("~$"), s, F.lit(".docx")))
        .when(m == 1, F.concat(s, F.lit(".bak")))
        .when((m == 2) & (F.col("c") == 1), F.concat(s, F.lit(" (1).txt")))
        .when(m == 3, F.concat(F.lit("setup"), s, F.lit(".exe")))
        .when(m == 4, F.concat(s, F.lit(".iso")))
        .when(m == 5, F.concat(F.lit("node_modules/"), s, F.lit(".js")))
        .when(m == 6, F.concat(s, F.lit(".vmdk")))
        .when(m == 7, s)
        .when(m == 8, F.concat(F.lit("2024-01-"), s, F.lit(".txt")))
        .when(m == 9, F.concat(F.lit("cache/"), s, F.lit(".dat")))
        .when(m == 10, F.concat(s, F.lit(".zip")))
        .when(m == 11, F.concat(s, F.lit(" - copy.txt")))
        .when(m == 12, F.concat((i % 20).cast("string"), F.lit("_"), s, F.lit(".pdf")))
        .when(m == 13, F.concat(F.lit("2023_02 "), s, F.lit(".jpg")))
        .when(m == 14, F.concat(s, F.lit(".mp3")))
        .otherwise(F.concat(s, F.lit(".txt")))
    )
    rows = docs.withColumn("c", F.explode(F.when(m == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    size = F.when(m == 15, 0).otherwise(F.col("n_chars")).cast("long")
    mtime = ((i * 7919) % 100000) * 1_000_000_000
    return rows.select(
        (i * 2 + F.col("c")).alias("entry_id"),
        F.lit("docs").alias("root"),
        F.concat_ws("/", "source", "lang", name).alias("relpath"),
        F.lit(False).alias("is_dir"),
        size.alias("size"),
        mtime.alias("mtime_ns"),
        (i * 2 + F.col("c") + 1000).alias("inode"),
        F.sha2(F.when((m == 2) & (i % 2 == 0) & (F.col("c") == 1), F.lit("other")).otherwise(F.col("text")), 256).alias("sha256"),
        F.when(i % 13 == 0, size + 1).otherwise(size).alias("hashed_size"),
        mtime.alias("hashed_mtime_ns"),
    )


ENTRIES_SQL = """entries AS (SELECT doc_id * 2 + c AS entry_id, 'docs' AS root, source || '/' || lang || '/' || CASE m
 WHEN 0 THEN '~$' || doc_id || '.docx' WHEN 1 THEN doc_id || '.bak' WHEN 2 THEN doc_id || CASE WHEN c = 1 THEN ' (1)' ELSE '' END || '.txt' WHEN 3 THEN 'setup' || doc_id || '.exe'
 WHEN 4 THEN doc_id || '.iso' WHEN 5 THEN 'node_modules/' || doc_id || '.js' WHEN 6 THEN doc_id || '.vmdk' WHEN 7 THEN doc_id::VARCHAR WHEN 8 THEN '2024-01-' || doc_id || '.txt'
 WHEN 9 THEN 'cache/' || doc_id || '.dat' WHEN 10 THEN doc_id || '.zip' WHEN 11 THEN doc_id || ' - copy.txt' WHEN 12 THEN (doc_id % 20) || '_' || doc_id || '.pdf'
 WHEN 13 THEN '2023_02 ' || doc_id || '.jpg' WHEN 14 THEN doc_id || '.mp3' ELSE doc_id || '.txt' END AS relpath,
 CASE WHEN m = 15 THEN 0 ELSE n_chars END AS size, (doc_id * 7919) % 100000 * 1000000000 AS mtime_ns, doc_id * 2 + c + 1000 AS inode,
 sha256(CASE WHEN m = 2 AND doc_id % 2 = 0 AND c = 1 THEN 'other' ELSE text END) AS sha256, CASE WHEN m = 15 THEN 0 ELSE n_chars END + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS hashed_size, doc_id % 13 <> 0 AS cur, doc_id, text, m, c
 FROM (SELECT *, doc_id % 31 AS m FROM documents) d JOIN (SELECT unnest([0, 1]) AS c) ON c = 0 OR m = 2)"""


def lineitem_catalog(lines: DataFrame) -> DataFrame:
    """A large tree: flag/status/year/month/order-line."""
    d = F.col("l_shipdate")
    path = F.concat_ws("/", "l_returnflag", "l_linestatus", F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    return lines.select(F.lit("lines").alias("root"), path.alias("relpath"), F.lit(False).alias("is_dir"), (F.col("l_quantity") * 100).cast("long").alias("size"))


LINES_SQL = "entries AS (SELECT 'lines' AS root, l_returnflag || '/' || l_linestatus || '/' || strftime(l_shipdate, '%Y/%m') || '/' || l_orderkey || '-' || l_linenumber AS relpath, (l_quantity * 100)::BIGINT AS size FROM lineitem)"


def second_observation(entries: DataFrame) -> DataFrame:
    """The tree one scan later: every 7th document gone, every 11th renamed, every 13th's inode and every 17th's size new."""
    i = F.floor(F.col("entry_id") / 2)
    path = F.when(i % 11 == 0, F.concat(F.lit("moved/"), "relpath")).otherwise(F.col("relpath"))
    return entries.filter(i % 7 != 0).select(
        "root", path.alias("relpath"), "is_dir", F.when(i % 17 == 0, F.col("size") + 5).otherwise(F.col("size")).alias("size"), "mtime_ns", F.when(i % 13 == 0, F.col("inode") + 10_000_000).otherwise(F.col("inode")).alias("inode"), "sha256"
    )


OBS_SQL = """obs AS (SELECT root, CASE WHEN doc_id % 11 = 0 THEN 'moved/' || relpath ELSE relpath END AS relpath, CASE WHEN doc_id % 17 = 0 THEN size + 5 ELSE size END AS size, mtime_ns,
 CASE WHEN doc_id % 13 = 0 THEN inode + 10000000 ELSE inode END AS inode, sha256 FROM entries WHERE doc_id % 7 <> 0)"""


def event_log(events: DataFrame) -> DataFrame:
    """Tag events: folder by user, tag by type; errors remove. seq follows event_id, which is in order of time."""
    u = F.col("user_id")
    return events.select(
        F.col("event_id").alias("seq"),
        F.lit("docs").alias("root"),
        F.concat(F.lit("src"), (u % 20).cast("string"), F.when(u % 3 == 0, "/en").otherwise("")).alias("path"),
        F.concat(F.col("event_type"), F.lit(":"), (u % 5).cast("string")).alias("tag"),
        F.when(F.col("event_type") == "error", "remove").when(F.col("value") < 10, "remove").otherwise("add").alias("op"),
    )


EVENTS_SQL = """ev AS (SELECT event_id AS seq, 'docs' AS root, 'src' || (user_id % 20) || CASE WHEN user_id % 3 = 0 THEN '/en' ELSE '' END AS path, event_type || ':' || (user_id % 5) AS tag,
 CASE WHEN event_type = 'error' OR value < 10 THEN 'remove' ELSE 'add' END AS op FROM events)"""


def full_log(events: DataFrame) -> DataFrame:
    """Metadata events of all kinds: folder by user, kind by event_id; every 89th moves a folder aside or back, every 211th changes the dictionary."""
    i, u, s = F.col("event_id"), F.col("user_id"), lambda c: c.cast("string")
    folder = F.concat(F.lit("src"), s(u % 20))
    path = F.concat(F.when(i % 3 == 0, "old/").otherwise(""), folder, F.when(u % 3 == 0, "/en").otherwise(""))
    far = F.concat(F.when(i % 7 == 0, "old/").otherwise(""), F.lit("src"), s((u + i) % 20))
    kinds = ["add", "add", "add", "remove", "attr-set", "attr-set", "attr-unset", "relate", "unrelate", "keep", "unkeep", "dir-type", "dir-card", "dir-extract", "review", "relink-skip"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.floor(i / 2) % len(kinds) + 1).cast("int"))
    words = F.element_at(F.array(*[F.lit(k) for k in ("rename", "alias", "unalias", "delete", "parent", "attr-undef")]), (F.floor(i / 211) % 6 + 1).cast("int"))
    op = F.when(i % 89 == 0, "move").when(i % 211 == 0, words).otherwise(kind)
    tag, other = F.concat("event_type", F.lit(":"), s(u % 5)), F.concat("event_type", F.lit(":"), s((u + 1) % 5))
    back = F.floor(i / 89) % 2 == 1
    moved = F.concat(F.lit("old/"), folder)
    src = F.when(op == "move", F.when(back, moved).otherwise(folder)).when(op == "rename", tag).otherwise(path)
    dst = F.when(op == "move", F.when(back, folder).otherwise(moved)).when(op == "rename", other).otherwise(far)
    return events.select(
        i.alias("seq"), op.alias("op"), F.lit("docs").alias("root"), path.alias("path"), tag.alias("tag"), src.alias("src"), dst.alias("dst"), other.alias("alias"), other.alias("parent"),
        F.concat(F.lit("n"), s(u % 4)).alias("name"), F.when(u % 2 == 0, "inbox").otherwise("").alias("type"), s(i).alias("value"), F.lit("linked").alias("kind"), s(u % 11).alias("sha256"),
        F.when(u % 2 == 0, "accept").otherwise("reject").alias("decision"), s(i).alias("reason"), F.when(u % 3 == 0, s(i)).otherwise("").alias("description"), F.lit("").alias("naming"), (u % 2 == 0).alias("extract"),
    )
