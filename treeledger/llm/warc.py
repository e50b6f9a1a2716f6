"""Resolution of not-modified revisits in web archives.

A revisit (status 304) is joined as of its time to the latest earlier full
response of its canonical URL; validators decide whether that response still
stands, and the headers that a 304 may update replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

# Header fields that a 304 response may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical(url: Column) -> Column:
    """Host in lower case without a default port, path without trailing slashes, query sorted and without utm fields; no scheme, no fragment. Null if there is no host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)([^?]*)\??(.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, pattern, 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, pattern, 2), "/+$", "")
    fields = F.filter(F.split(F.regexp_extract(bare, pattern, 3), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit with its base; records: record_id, url, ts, status, etag, last_modified, digest, headers (map).

    Full responses have status 200; "earlier" means a smaller (ts, record_id).
    Result: record_id, canonical, base_id, outcome, headers, digest. Outcomes:
    ``no base`` (also for a null URL), ``validated`` (ETags equal, weakly; else
    Last-Modified; else digest), ``mismatch``, and ``unvalidated`` if both
    sides share no validator. Digest and merged headers are given for
    validated revisits, others keep their own headers; header names compare
    without case, null maps are empty, null values replace nothing. Records
    without time sort first; repeated rows are resolved each; of full responses
    with equal (ts, record_id) either may be the base. An empty table gives an
    empty result; columns of other names aren't read.

    Records are dealt by ranges of (URL, time), so a URL with a large share of
    all records is spread over tasks; only the last full response of each URL
    and task is carried on to the next tasks.
    """
    full = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    slim = records.select("record_id", canonical(F.col("url")).alias("canonical"), "ts", "status", "etag", "last_modified", "digest", "headers")
    dealt = written(slim.filter("canonical IS NOT NULL").repartitionByRange("canonical", "ts", "record_id").withColumn("pid", F.spark_partition_id()))
    here = W.partitionBy("canonical", "pid").orderBy("ts", "record_id")
    inside = dealt.withColumn("near", F.last(F.when(F.col("status") == 200, full), ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, -1)))
    tails = dealt.groupBy("canonical", "pid").agg(F.max_by(F.when(F.col("status") == 200, full), F.when(F.col("status") == 200, F.struct("ts", "record_id"))).alias("tail"))
    over = W.partitionBy("canonical").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.withColumn("carried", F.last("tail", ignorenulls=True).over(over)).filter("carried IS NOT NULL").select("canonical", "pid", "carried")
    found = inside.filter("status = 304").join(carried, ["canonical", "pid"], "left").withColumn("base", F.coalesce("near", "carried"))
    lost = slim.filter("status = 304 AND canonical IS NULL").withColumn("base", F.lit(None).cast(found.schema["base"].dataType))
    columns = ["record_id", "canonical", "etag", "last_modified", "digest", "headers", "base"]
    found = found.select(*columns).union(lost.select(*columns))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    both = lambda a: F.col(a).isNotNull() & F.col(f"base.{a}").isNotNull()
    outcome = (
        F.when(F.col("base").isNull(), "no base")
        .when(both("etag"), F.when(weak(F.col("etag")) == weak(F.col("base.etag")), "validated").otherwise("mismatch"))
        .when(both("last_modified"), F.when(F.col("last_modified") == F.col("base.last_modified"), "validated").otherwise("mismatch"))
        .when(both("digest"), F.when(F.col("digest") == F.col("base.digest"), "validated").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    new = F.map_filter(own, lambda k, v: F.lower(k).isin(PERMITTED) & v.isNotNull())
    named = F.transform(F.map_keys(new), F.lower)
    old = F.map_filter(F.coalesce("base.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(named, F.lower(k)))
    good = F.col("outcome") == "validated"
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "canonical",
        F.col("base.record_id").alias("base_id"),
        "outcome",
        F.when(good, F.map_concat(old, new)).otherwise(own).alias("headers"),
        F.when(good, F.col("base.digest")).alias("digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records that follow from the pages: a full response, and two revisits of which some have lost or changed validators."""
    i, page = F.col("i"), F.col("page_id")
    digest = F.sha2(F.col("html"), 256)
    rows = pages.select("page_id", "url", "html").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    etag = F.when(i == 0, F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))).when((i == 1) & (page % 5 != 0), F.concat(F.lit('W/"'), F.substring(digest, 1, 16), F.lit('"'))).when(i == 1, F.lit('"changed"'))
    modified = F.when((i == 0) | ((i == 2) & (page % 3 != 0)), F.concat(F.lit("day "), (page % 365).cast("string")))
    headers = F.when(i == 0, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.lit("d0"), F.lit("vary"), F.lit("accept"))).otherwise(
        F.create_map(F.lit("content-type"), F.lit("none"), F.lit("date"), F.concat(F.lit("d"), i.cast("string")), F.lit("expires"), (page % 7).cast("string"))
    )
    return rows.select(
        (page * 3 + i).alias("record_id"),
        "url",
        (page % 1000 + i * 500).cast("long").alias("ts"),
        F.when((i == 0) & F.col("html").isNotNull(), 200).otherwise(304).alias("status"),
        etag.alias("etag"),
        modified.alias("last_modified"),
        F.when(i == 0, digest).alias("digest"),
        headers.alias("headers"),
    )


def warc_digest(pages: DataFrame) -> DataFrame:
    """op9: every revisit's base, outcome, payload digest and merged headers as sorted text."""
    out = resolve(captures(pages))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.select("record_id", "canonical", "base_id", "outcome", "digest", F.array_join(pairs, "; ").alias("headers"))


WARC_SQL = r"""
WITH b AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u, html, sha256(html) AS dg FROM pages),
c AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)([^?]*)\??(.*)$', 1)), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)([^?]*)\??(.*)$', 2), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)([^?]*)\??(.*)$', 3), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS q FROM b),
k AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM c),
r AS (SELECT page_id * 3 + i AS record_id, canonical, page_id % 1000 + i * 500 AS ts, CASE WHEN i = 0 AND html IS NOT NULL THEN 200 ELSE 304 END AS status, page_id, i, dg AS d0,
  CASE WHEN i = 0 THEN '"' || dg[1:16] || '"' WHEN i = 1 AND page_id % 5 <> 0 THEN '"' || dg[1:16] || '"' WHEN i = 1 THEN '"changed"' END AS etag,
  CASE WHEN i = 0 OR (i = 2 AND page_id % 3 <> 0) THEN 'day ' || (page_id % 365) END AS lm FROM k, (SELECT unnest([0, 1, 2]) AS i)),
a AS (SELECT *, last_value(CASE WHEN status = 200 THEN {'id': record_id, 'etag': etag, 'lm': lm, 'd': d0} END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM r),
o AS (SELECT *, CASE WHEN canonical IS NULL OR base IS NULL THEN 'no base' WHEN etag IS NOT NULL THEN CASE WHEN etag = base.etag THEN 'validated' ELSE 'mismatch' END
  WHEN lm IS NOT NULL THEN CASE WHEN lm = base.lm THEN 'validated' ELSE 'mismatch' END ELSE 'unvalidated' END AS outcome FROM a WHERE status = 304)
SELECT record_id, canonical, base.id AS base_id, outcome, CASE WHEN outcome = 'validated' THEN base.d END AS digest,
  CASE WHEN outcome = 'validated' THEN 'content-type: text/html; date: d' || i || '; expires: ' || (page_id % 7) || '; vary: accept' ELSE 'content-type: none; date: d' || i || '; expires: ' || (page_id % 7) END AS headers FROM o
"""
