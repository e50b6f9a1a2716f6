"""Repeated passages by a sparse suffix array.

A window of ``PASSAGE`` words is anchored where the smallest hash of ``GRAM``
consecutive words in it stands first (its minimiser), so equal windows have
equal anchors. A piece is a run of windows of a text with one anchor: the
words left of it, and the retained suffix from it on. Pieces whose anchor's
words occur nowhere else are dropped, and equal pieces are counted as one.

The others form the suffix array: pieces sorted by (anchor, suffix), in ranges
of about equal size. Neighbours are compared, which tells how many words each
suffix shares with the one before. The best partner of a window need not be
its suffix's neighbour, so matches are extended to the left inside every run
of suffixes that share enough words: with a words left of the anchor and the
others right of it, a window repeats if another piece of the run has the same
a words on its left.

Where a range ends amid the pieces of one anchor, partners may lie beyond; the
windows of these pieces alone meet in a join on a 128-bit hash of their words.
A very frequent anchor is so spread over many ranges.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_tokens, release, written
from .textbytes import Tokens, chunks, mix64

PASSAGE, GRAM = 50, 16
#: Bytes of repeated anchors up to which they are broadcast; beyond, they are joined.
BROADCAST_BYTES = 32 << 20
#: Pieces that are compared at a time.
RANGE = 1 << 15


def _least(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least value of every run of ``width``, and where it stands first."""
    best, at, reach = x, np.arange(len(x)), 1
    while reach < width:
        step = min(reach, width - reach)
        less = best[step:] < best[:-step]
        best, at = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
        reach += step
    return best, at


def _runs(h: np.ndarray, at: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first window, number of windows, anchor (in words of the chunk) and the anchor's hash."""
    n = len(h) - passage + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    g, weight = np.zeros(len(h) - gram + 1, np.uint64), 1
    for j in range(gram):
        g += h[j : j + len(g)] * np.uint64(weight)
        weight = (weight * 0xC2B2AE3D27D4EB4F) % (1 << 64)
    least, where = _least(mix64(g), passage - gram + 1)
    inside = np.arange(n) + passage <= at[1:][row[:n]]
    first = inside & np.concatenate([[True], (where[1:] != where[:-1]) | (row[1:n] != row[: n - 1])])
    start = np.flatnonzero(first)
    count = np.bincount(np.cumsum(first)[inside] - 1, minlength=len(start))
    return row[start], start, count, where[start], least[start]


def _bare(tokens: Tokens, data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chunk's words in lower case, each followed by one space, and where they begin (one more at the end)."""
    starts, ends, _ = tokens.spans(data, offs)
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(to[-1], 32, np.uint8)
    index = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to[:-1], size) + index] = data[np.repeat(starts, size) + index]
    out[(out >= 65) & (out <= 90)] += 32
    return out.tobytes(), to


def _anchors(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    """(k): hashes of the anchors that more than one piece has."""

    def run(batches):
        tokens = Tokens()
        for b in batches:
            for _, _, data, offs in chunks(b.column(0)):
                h, c = np.unique(_runs(*tokens.hashes(data, offs), passage, gram)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["k", "c"])

    return docs.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).filter("c > 1").select("k")


def _pieces(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    """(doc_id, th, anchor, windows, k, left, words, suffix): pieces whose anchor occurs again; ``words``, ``left`` of them, stand before it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = written(_anchors(docs, passage, gram))
    small = keys.count() * 8 <= BROADCAST_BYTES
    held = np.sort(keys.toArrow().column("k").to_numpy().view(np.uint64)) if small else None
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        tokens, known = Tokens(), shared.value
        for b in batches:
            for lo, _, data, offs in chunks(b.column(2)):
                h, at = tokens.hashes(data, offs)
                row, start, count, anchor, key = _runs(h, at, passage, gram)
                if known is not None and len(key):
                    spot = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                    take = known[spot] == key if len(known) else np.zeros(len(key), bool)
                    row, start, count, anchor, key = (x[take] for x in (row, start, count, anchor, key))
                if not len(key):
                    continue
                text, to = _bare(tokens, data, offs)
                edges = zip(to[start].tolist(), to[anchor].tolist(), to[start + count + passage - 1].tolist(), strict=True)
                left, right = zip(*((text[i:j], text[j:e]) for i, j, e in edges), strict=True)
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(anchor - at[row]), pa.array(count), pa.array(key.view(np.int64)), pa.array(anchor - start), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    ["doc_id", "th", "anchor", "windows", "k", "left", "words", "suffix"],
                )

    found = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, anchor long, windows long, k long, left long, words binary, suffix binary")
    return found if small else found.join(keys, "k", "left_semi")


def _words(column: pa.Array, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the rows' offsets."""
    held, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, data, offs in chunks(column.cast(pa.string())):
        h, o = tokens.hashes(data, offs)
        held.append(h)
        at.append(o[1:] + at[-1][-1])
    return np.concatenate(held), np.concatenate(at)


def matches(k: np.ndarray, words: pa.Array, suffix: pa.Array, windows: np.ndarray, passage: int, gram: int) -> np.ndarray:
    """Of distinct pieces in order of (anchor, suffix): the windows that two of them share, bit a for a words left of the anchor."""
    tokens, n = Tokens(), len(k)
    (lw, la), (rw, ra) = _words(words, tokens), _words(suffix, tokens)
    n_left, n_right = np.diff(la), np.diff(ra)
    shared = np.zeros(n, np.int64)  # words in common with the suffix before
    going = np.flatnonzero(np.concatenate([[False], k[1:] == k[:-1]]))
    for j in range(passage):
        going = going[(n_right[going] > j) & (n_right[going - 1] > j)]
        going = going[rw[ra[going] + j] == rw[ra[going - 1] + j]]
        shared[going] = j + 1
    mask, group = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(passage - gram + 1):
        if a:  # pieces with the same a words left of the anchor
            word = np.zeros(n, np.uint64)
            has = np.flatnonzero(n_left >= a)
            word[has] = lw[la[has + 1] - a]
            group = np.unique(mix64(word) ^ mix64(group.astype(np.uint64) + np.uint64(1)), return_inverse=True)[1]
        use = np.flatnonzero((n_left >= a) & (n_left - windows < a))
        pair = np.cumsum(shared < passage - a)[use] * (n + 1) + group[use]
        order = np.argsort(pair, kind="stable")
        same = pair[order[1:]] == pair[order[:-1]]
        twin = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(use) else np.zeros(0, bool)
        mask[use[order[twin]]] |= 1 << a
    return mask


def _digests(words: bytes, suffix: bytes, windows: int, passage: int):
    """(a, hash) of a piece's windows."""
    left, right = words.split(), suffix.split()
    for a in range(len(left) - windows + 1, len(left) + 1):
        yield a, blake2b(b" ".join(left[len(left) - a :] + right[: passage - a]), digest_size=16).digest()


def _array(pieces: DataFrame, passage: int, gram: int) -> DataFrame:
    """(k, x, mask, w): each distinct piece's windows that its range has twice (w null), and windows whose partners may be in another range (w: their hash)."""

    def compared(t: pa.Table, outer: np.ndarray):
        k, x, words, suffix = t.column("k"), t.column("x"), t.column("words"), t.column("suffix")
        windows = t.column("windows").to_numpy()
        mask = matches(k.to_numpy(), words.combine_chunks(), suffix.combine_chunks(), windows, passage, gram)
        yield pa.RecordBatch.from_arrays([k.combine_chunks(), x.combine_chunks(), pa.array(mask), pa.nulls(len(t), pa.binary())], ["k", "x", "mask", "w"])
        for lo in range(0, len(outer), 1024):
            out = [(k[i].as_py(), x[i].as_py(), 1 << a, w) for i in outer[lo : lo + 1024].tolist() for a, w in _digests(words[i].as_py(), suffix[i].as_py(), int(windows[i]), passage)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["k", "x", "mask", "w"])

    def run(batches):
        held, size, torn = [], 0, None  # torn: the anchor that the pieces before the held ones may share
        for b in batches:
            if not len(b):
                continue
            torn = int(b.column(0)[0].as_py()) if torn is None else torn
            held.append(b)
            size += len(b)
            if size < RANGE:
                continue
            t = pa.Table.from_batches(held)
            k = t.column("k").to_numpy()
            others = np.flatnonzero(k != k[-1])
            if len(others):  # the last anchor's pieces wait for the others of it
                cut, after = int(others[-1]) + 1, False
            else:
                cut, after = len(k), int(k[-1])
            yield from compared(t.slice(0, cut), np.flatnonzero(k[:cut] == torn) if torn is not False else np.zeros(0, np.int64))
            held, size, torn = t.slice(cut).to_batches(), len(k) - cut, after
        if size:
            t = pa.Table.from_batches(held)
            k = t.column("k").to_numpy()
            yield from compared(t, np.flatnonzero((k == k[-1]) | ((k == torn) if torn is not False else False)))

    ranges = pieces.select("k", "x", "words", "suffix", "windows").repartitionByRange("k", "suffix").sortWithinPartitions("k", "suffix", "words")
    return ranges.mapInArrow(run, "k long, x long, mask long, w binary")


def repeated_windows(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, starts): the windows of ``passage`` words that occur in more than one place, by anchor; th hashes the text."""
    gram = max(min(gram, passage), passage - 61)
    pieces = written(_pieces(docs, passage, gram).withColumn("x", F.xxhash64("words", "suffix")))
    same = written(pieces.groupBy("k", "x", "words", "suffix", "windows", "left").agg(F.count(F.lit(1)).alias("c")))
    release(docs.sparkSession)
    found = written(_array(same, passage, gram))
    release(docs.sparkSession)
    outer = found.filter("w IS NOT NULL")
    twice = outer.groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w")
    every = same.filter("c > 1").select("k", "x", F.expr("shiftleft(shiftleft(1L, int(windows)) - 1, int(left - windows + 1))").alias("mask"))
    masks = found.filter("w IS NULL").select("k", "x", "mask").union(outer.join(twice, "w", "left_semi").select("k", "x", "mask")).union(every)
    # as a table, so that the join reads plain shuffles and can split a piece that very many places share
    masks = written(masks.groupBy("k", "x").agg(F.bit_or("mask").alias("mask")).filter("mask <> 0"))
    at = F.transform(F.sequence(F.lit(0), F.lit(passage - gram)), lambda a: F.when(F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), a)) != 0, F.col("anchor") - a))
    return pieces.select("doc_id", "th", "anchor", "k", "x").join(masks, ["k", "x"]).select("doc_id", "th", F.filter(at, lambda s: s.isNotNull()).alias("starts"))


def repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Per row: doc_id, n_words, n_repeated (words inside repeated passages), n_spans and spans (start, end in words; end excluded).

    Texts that are null, empty or shorter than a passage have none; an empty
    table gives an empty result; other columns are not looked at. Rows with
    the same id and text (repeated rows) have the same answer, and repeat each
    other. Passages that touch or overlap form one span. A text is held whole
    by one task, however long.
    """
    found = repeated_windows(docs.select("doc_id", "text"), passage).groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("s"))
    gaps = F.filter(F.transform(F.col("s"), lambda x, i: F.when((i == 0) | (x > F.get("s", i - 1) + passage), i)), lambda i: i.isNotNull())
    spans = F.transform(F.col("g"), lambda i, j: F.struct(F.get("s", i).alias("start"), (F.get("s", F.coalesce(F.get("g", j + 1), F.size("s")) - 1) + passage).alias("end")))
    found = found.withColumn("g", gaps).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), spans.alias("spans"))
    held = docs.select("doc_id", F.xxhash64("text").alias("th"), n_tokens(F.col("text")).alias("n_words"))
    out = held.join(found, held["doc_id"].eqNullSafe(found["__id"]) & (held["th"] == found["__th"]), "left")
    inside = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_words", F.coalesce(inside, F.lit(0)).alias("n_repeated"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), "spans")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """op4: repeated passages of every document; the spans as text, start-end, comma-joined."""
    text = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return repeats(docs).select("doc_id", "n_words", "n_repeated", "n_spans", F.coalesce(text, F.lit("")).alias("spans"))


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, s FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, s, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS n FROM r)),
p AS (SELECT doc_id, g, min(s) AS a, max(s) + 50 AS b FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS c, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(t.n, 0)::BIGINT AS n_repeated, coalesce(t.c, 0)::BIGINT AS n_spans, coalesce(t.spans, '') AS spans FROM d LEFT JOIN t USING (doc_id)
"""
