"""Benchmark decontamination by a broadcast hash set of test n-grams.

The words of every benchmark item give windows of n consecutive words (an item
of fewer words is one window). A set of hashes of the windows' opening words,
sent to every task, tells where in a text a window can begin at all; only
these places become rows, with their window's words. They meet the windows by hash
and words: broadcast while the windows are below ``BROADCAST_BYTES``, else by
a shuffle of both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_names, words_of, written

#: Bytes of windows up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Opening words of a window that the hash set looks at, and its places (a byte each), at least and at most.
OPENING, PLACES, PLACES_MOST = 3, 1 << 16, 1 << 22


def windows(bench: DataFrame, n: int = 10) -> DataFrame:
    """(l, h, w, items): each distinct window with its length, hash, words and sorted item ids."""
    held = bench.select(F.col("item_id").alias("__item"), words_of(F.col("text")).alias("__w")).filter(F.size("__w") > 0)
    held = held.withColumn("l", F.least(F.size("__w"), F.lit(n)))
    starts = F.sequence(F.lit(0), F.size("__w") - F.col("l"))
    each = held.select("__item", "l", F.explode(F.transform(starts, lambda p: F.slice("__w", p + 1, F.col("l")))).alias("w"))
    return each.groupBy("l", "w").agg(F.collect_set("__item").alias("items")).withColumn("h", F.xxhash64("l", "w"))


def _opening(words: Column, at: Column, size: int, places: int) -> Column:
    """Place in the hash set of the opening words of a window of ``size`` words at ``at`` (from 0)."""
    return F.pmod(F.xxhash64(F.lit(min(size, OPENING)), *(F.get(words, at + j) for j in range(min(size, OPENING)))), F.lit(places)).cast("int")


def _openings(wins: DataFrame, lengths: list[int], count: int) -> bytes:
    """A byte per place, 1 where a window's opening falls; beyond 4 MB more of a text passes it, which costs time only."""
    places = min(PLACES_MOST, max(PLACES, 1 << (8 * count).bit_length()))
    place = reduce(lambda other, l: F.when(F.col("l") == l, _opening(F.col("w"), F.lit(0), l, places)).otherwise(other), lengths, F.lit(None).cast("int"))
    out = bytearray(places)
    for p in wins.select(place.alias("p")).distinct().toArrow().column("p").to_pylist():
        out[p] = 1
    return bytes(out)


def overlaps(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, __th (hash of its text), n_words, n_hit, item_ids (sorted strings), spans.

    Rows with the same id and text are counted and given back as often. Null
    texts have no words; null items, ids and empty items hit nothing (a null
    item_id's windows count as hits, but not as an item). A text's words stay
    in its own row however long it is; other columns are not looked at.
    """
    wins = written(windows(bench, n))
    size = F.sum(F.length(F.array_join("w", " ")) + 16 * F.size("items") + 64)
    count, total = wins.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    lengths = sorted(r["l"] for r in wins.select("l").distinct().collect())  # n values at most
    openings = _openings(wins, lengths, count)
    words = F.col("__words")
    held = docs.select("doc_id", F.xxhash64("text").alias("__th"), words_of(F.col("text")).alias("__words"))

    def begins(p: Column, l: int) -> Column:
        return F.substring(F.lit(openings), _opening(words, p, l, len(openings)) + 1, F.lit(1)) == F.lit(b"\x01")

    def places(l: int) -> Column:
        """The windows of ``l`` words that may be of the benchmark."""
        every = F.when(F.size(words) >= l, F.sequence(F.lit(0), F.size(words) - l)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(every, lambda p: begins(p, l)), lambda p: F.struct(F.lit(l).alias("l"), p.alias("p"), F.slice(words, p + 1, l).alias("w")))

    mark = F.array(F.struct(F.lit(0).alias("l"), F.size(words).alias("p"), F.lit(None).cast("array<string>").alias("w")))
    # explode_outer: the array is never empty, and no size check doubles the work that makes it
    each = held.select("doc_id", "__th", F.explode_outer(F.concat(mark, *[places(l) for l in lengths])).alias("__e"))
    each = each.select("doc_id", "__th", F.col("__e.l").alias("__l"), F.col("__e.p").alias("__p"), F.col("__e.w").alias("__w"))
    # rows that mark a document meet nothing: their hash is their own, so that no task gets all of them
    each = each.withColumn("__h", F.when(F.col("__l") > 0, F.xxhash64("__l", "__w")).otherwise(F.xxhash64("doc_id", "__th")))
    wins = wins.select(F.col("h").alias("__wh"), F.col("w").alias("__ww"), F.col("items").alias("__items"))
    same = (F.col("__h") == F.col("__wh")) & (F.col("__w") == F.col("__ww"))
    hits = each.join(F.broadcast(wins) if total <= BROADCAST_BYTES else wins, same, "left")
    first = F.col("__l") == 0
    rows = hits.filter(first | F.col("__wh").isNotNull()).select(
        "doc_id",
        "__th",
        F.when(first, F.col("__p")).alias("__n"),
        F.when(first, 1).alias("__one"),
        F.when(~first, F.struct(F.col("__p").alias("p"), F.col("__l").alias("l"))).alias("__span"),
        F.when(~first, F.col("__items")).alias("__items"),
    )
    per = rows.groupBy("doc_id", "__th").agg(
        F.count("__one").alias("__rows"), F.max("__n").alias("n_words"), F.collect_set("__span").alias("__spans"), F.flatten(F.collect_set("__items")).alias("__ids")
    )
    hit = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["p"], s["p"] + s["l"] - 1))))
    ids = F.array_sort(F.transform(F.array_distinct("__ids"), lambda i: i.cast("string")))
    per = per.select("doc_id", "__th", "__rows", F.col("n_words").cast("long").alias("n_words"), F.size(hit).cast("long").alias("n_hit"), ids.alias("item_ids"), F.array_sort("__spans").alias("spans"))
    return per.withColumn("__i", F.explode_outer(F.sequence(F.lit(1), F.col("__rows").cast("int")))).drop("__i", "__rows")


@own_names
def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, min_hit: int = 1) -> DataFrame:
    """``docs`` without the documents of which ``min_hit`` or more words are inside benchmark windows; its columns stay as they are, whatever their names.

    Null and empty texts have no words and stay; repeated rows share one
    verdict; items that hold the same window count alike; without documents,
    or without items, ``docs`` comes out as it is. Whole texts are read.
    """
    flagged = overlaps(docs, bench, n).filter(F.col("n_hit") >= min_hit)
    flagged = written(flagged.select(F.col("doc_id").alias("__id"), "__th").distinct())
    same = docs["doc_id"].eqNullSafe(flagged["__id"]) & (F.xxhash64(docs["text"]) == flagged["__th"])
    return docs.join(flagged, same, "left_anti")


def decontaminate_digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """op5: per document its words, hit words and the items whose windows occur; no item gives the hash of the empty text."""
    return overlaps(docs, bench).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, ls WHERE len(w) >= l)),
h AS (SELECT dw.doc_id, dw.l, dw.p, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items, sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
