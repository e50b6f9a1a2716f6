"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

p(token | history) is a product over nested classes: the end of a text, the
most frequent tokens (one item each) and hashed leaves of all others lie on a
line in order of frequency, each as wide as its mass, and every binary digit
of an item's place on it is a choice between two classes. A choice is a
softmax over hashed features of the history, each together with the class it
splits: the previous token, the previous two, and (skip) the one before last.
Items that share a place, and tokens in a leaf, have their shares of its mass;
add-one smoothing of the others leaves room for unseen tokens.

A unit is a run of documents of one task. Its distinct n-grams (two tokens and
the next, with their number in training documents) are dealt to shards by
their history, about ``SHARD`` to each, so the shards grow in number with the
corpus and a very frequent n-gram is one row of a unit. A shard holds all
n-grams of its histories, sizes its weight tables by them and fits the weights
by damped gradient steps on their summed counts, one table at a time; no
weights leave it. What comes back are the n-grams' log probabilities, which
the units look up for all positions of their documents. Sums are taken in
fixed orders: how the table is partitioned makes no difference to a score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, release, written
from .textbytes import Tokens, chunks, mix64

#: Tokens with an item of their own, leaves of the others, and binary digits, at most: what every task holds.
HEAD, LEAVES, DEPTH = 1 << 18, 1 << 18, 22
#: Bits of an item's number; three of them are an n-gram.
BITS = np.uint64(20)
#: Tokens of a unit, n-grams of a shard, sweeps over the weight tables, and the damping of a step.
UNIT, SHARD, SWEEPS, RIDGE = 1_500_000, 1 << 19, 1, 0.7
FOLDS, HELD_OUT = 7, 2
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_ABOUT = "unit long, kind int, shard int, n long, data binary"


def fold():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _texts(batches, column: int = 0):
    """Per chunk: batch, first row, token hashes with an end (0) after each text, and the rows' offsets."""
    tokens = Tokens()
    for b in batches:
        for lo, hi, data, offs in chunks(b.column(column)):
            h, at = tokens.hashes(data, offs)
            out = np.zeros(len(h) + hi - lo, np.uint64)
            out[np.arange(len(h)) + np.repeat(np.arange(hi - lo), np.diff(at))] = np.maximum(h, np.uint64(1))
            yield b, lo, out, at + np.arange(len(at))


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c): occurrences of every token of the training documents; h is 0 for ends."""

    def run(batches):
        held, size = [], 0
        for _, _, h, _ in _texts(batches):
            held.append(h)
            size += len(h)
            if size > 3_000_000:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def flush(held):
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.filter(fold() != HELD_OUT).select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Head:
    """The frequent tokens (sorted hashes), their counts in falling order, and every item's place and share of it."""

    def __init__(self, h: np.ndarray, c: np.ndarray, ends: int, v: int) -> None:
        order = np.lexsort((h, -c))
        self.c, self.ends = c[order], ends
        self.rank = np.argsort(h[order])
        self.h = h[order][self.rank]
        rest = max(v - len(h), 1)
        self.leaves = min(LEAVES, 1 << max(0, math.ceil(math.log2(rest / 8))))

    def items(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's item (0 the end, then the head, then the leaves), and whether it is of a leaf."""
        leaf = len(self.h) + 1 + (mix64(h + _ODD) & np.uint64(self.leaves - 1)).astype(np.int64)
        if not len(self.h):
            return np.where(h == 0, 0, leaf), h != 0
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return np.where(h == 0, 0, np.where(known, self.rank[at] + 1, leaf)), ~known & (h != 0)

    def close(self, rest: np.ndarray) -> None:
        """``rest``: add-one mass of the counted tokens in each leaf; one more is left for the unseen."""
        mass = np.concatenate([[self.ends + 1.0], self.c, rest + 1.0])
        self.rest_log = np.log10(rest + 1.0)
        line = np.argsort(-mass, kind="stable")
        middle = np.empty(len(mass))
        middle[line] = (np.cumsum(mass[line]) - mass[line] / 2) / mass.sum()
        self.depth = min(DEPTH, math.ceil(math.log2(len(mass))) + 2)
        self.place = np.minimum((middle * (1 << self.depth)).astype(np.int64), (1 << self.depth) - 1)
        below = np.bincount(self.place, mass, 1 << self.depth)
        self.share = np.log10(mass / below[self.place])
        levels = []
        while len(below) > 1:
            left, right = below[0::2], below[1::2]
            levels.append(np.where((left > 0) & (right > 0), np.log(np.maximum(right, 1e-300)) - np.log(np.maximum(left, 1e-300)), np.nan).astype(np.float32))
            below = left + right
        #: Prior log odds of each class's second half by (1 << level) + class; none where only one half has items.
        self.odds = np.concatenate([np.full(1, np.nan, np.float32), *levels[::-1]])


def _rest_mass(counts: DataFrame, known) -> np.ndarray:
    """Add-one mass of each leaf."""

    def run(batches):
        head = known.value
        mass = np.zeros(head.leaves, np.int64)
        for b in batches:
            h, c = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            item, rest = head.items(h)
            np.add.at(mass, item[rest] - len(head.h) - 1, c[rest] + 1)
        at = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass[at])], ["leaf", "mass"])

    got = counts.select("h", "c").mapInArrow(run, "leaf long, mass long").groupBy("leaf").agg(F.sum("mass").alias("mass")).toArrow()
    out = np.zeros(known.value.leaves)
    out[got.column("leaf").to_numpy()] = got.column("mass").to_numpy()
    return out


def ngrams(item: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every position's token, the one before and the one before that as one number; 0 stands for what is before a text."""
    index = np.arange(len(item)) - np.repeat(at[:-1], np.diff(at))
    key = item.astype(np.uint64)
    one, two = (np.where(index >= d, np.concatenate([np.zeros(min(d, len(key)), np.uint64), key[:-d]])[: len(key)], np.uint64(0)) for d in (1, 2))
    return (((one << BITS) | two) << BITS) | key


def parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, the one before, token) of n-grams."""
    low = np.uint64((1 << int(BITS)) - 1)
    return key >> (BITS + BITS), (key >> BITS) & low, key & low


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of numbers, and where each distinct one begins in it."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def fit(head: Head, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural log p(item | history) of distinct n-grams, by a model fitted to those that occur ``n`` > 0 times in training."""
    p, q, code = parts(grams)
    out = np.zeros(len(code), np.float64)
    place = head.place[code.astype(np.int64)].astype(np.uint32)
    keys = [mix64(p + _ODD), mix64((q << np.uint64(32)) + p + _STEP), mix64(q * np.uint64(3) + np.uint64(1))]
    bits = max(1, int(len(code) - 1).bit_length())
    times = n.astype(np.float32)
    for level in range(head.depth):
        node = (place >> np.uint32(head.depth - level)) | np.uint32(1 << level)
        prior = head.odds[node]
        use = np.flatnonzero(~np.isnan(prior))
        if not len(use):
            continue
        z, right, t = prior[use], ((place[use] >> np.uint32(head.depth - level - 1)) & np.uint32(1)).astype(np.float32), times[use]
        salt = mix64(node[use].astype(np.uint64))
        rows = [(((k[use] ^ salt) * _STEP) >> np.uint64(64 - bits)).astype(np.int64) for k in keys]
        for _ in range(SWEEPS):
            for f in rows:
                chance = 1 / (1 + np.exp(-z))
                slope = np.bincount(f, t * (right - chance), 1 << bits)
                bend = np.bincount(f, t * chance * (1 - chance), 1 << bits)
                z = z + (slope / (bend + RIDGE)).astype(np.float32)[f]
        out[use] -= np.logaddexp(0, np.where(right > 0, -z, z))
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """32-bit columns by byte planes, compressed."""
    return pa.Codec("zstd").compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns), asbytes=True)


def _unpack(data: bytes, n: int, kinds: list) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, n * 4 * len(kinds), asbytes=True), np.uint8).reshape(len(kinds), 4, n)
    return [np.ascontiguousarray(r.T).reshape(-1).view(k) for r, k in zip(raw, kinds, strict=True)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    units, kinds, shards, ns, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(kinds, pa.int32()), pa.array(shards, pa.int32()), pa.array(ns, pa.int64()), pa.array(data, pa.binary())], ["unit", "kind", "shard", "n", "data"])


def _units(docs: DataFrame, shared, shards: int) -> DataFrame:
    """Kind 1: a unit's n-grams for one shard; kind 0: all that the unit's documents need besides, with each position's n-gram."""

    def deal(batches):
        head = shared.value
        log_head = np.log10(np.concatenate([[head.ends], head.c]) + 1)
        split = (np.concatenate([[head.ends], head.c, np.zeros(head.leaves, np.int64)]) * 2 // SHARD + 1).astype(np.uint64)
        unit = TaskContext.get().partitionId() << 32
        tables, held, size = [], [], 0

        def flush():
            key, train = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = distinct(key)
            n = np.add.reduceat(train[order].astype(np.int64), first).astype(np.int32)
            which = np.empty(len(order), np.int64)
            which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            prev, prev2, code = parts(key[order[first]])
            deal = mix64(prev2 + _ODD) % split[prev.astype(np.int64)]
            shard = (mix64(prev + _ODD * (deal + np.uint64(1))) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            spot = np.empty(len(by), np.uint32)
            spot[by] = np.arange(len(by))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for t in tables:
                    w.write_batch(t)
            index = _pack(spot[which])
            rows = [(unit, 0, (unit ^ (unit >> 32)) % shards, len(which), len(index).to_bytes(8, "little") + index + sink.getvalue().to_pybytes())]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1]])), len(by))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                o = by[lo:hi]
                rows.append((unit, 1, int(shard[o[0]]), hi - lo, _pack(*(x[o].astype(np.uint32) for x in (prev, prev2, code)), n[o])))
            return _rows(rows)

        for b, lo, h, at in _texts(batches, 2):
            item, rest = head.items(h)
            known = ~rest & ((h != 0) | (head.ends > 0))
            base = np.where(rest, 0.0, log_head[np.where(rest, 0, item)])
            model = head.share[item]
            model[rest] -= head.rest_log[item[rest] - len(head.h) - 1]
            total = lambda x: np.add.reduceat(x, at[:-1])
            cuts = np.concatenate([[0], np.cumsum(total(rest.astype(np.int64)))])
            rows = slice(lo, lo + len(at) - 1)
            out = b.column(1)[rows]
            tables.append(
                pa.RecordBatch.from_arrays(
                    [b.column(0)[rows], out, pa.array(np.diff(at)), pa.array(total(known.astype(np.int64))), pa.array(total(base)), pa.array(total(model)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h[rest].view(np.int64)))],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "model", "cold"],
                )
            )
            held.append((ngrams(item, at), np.repeat(~out.to_numpy(zero_copy_only=False), np.diff(at))))
            size += len(h)
            if size > UNIT:
                yield flush()
                tables, held, size, unit = [], [], 0, unit + 1
        if held:
            yield flush()

    return docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "text").mapInArrow(deal, _ABOUT)


def _solve(shared):
    """Rows sorted by shard, kind and unit: those of kind 1 become kind 2, with log10 p of their n-grams; the others pass."""

    def solve(held):
        columns = [_unpack(d, m, [np.uint32, np.uint32, np.uint32, np.int32]) for _, m, d in held]
        prev, prev2, code, n = (np.concatenate(x) for x in zip(*columns, strict=True))
        key = (((prev.astype(np.uint64) << BITS) | prev2) << BITS) | code
        order, first = distinct(key)
        p = fit(shared.value, key[order[first]], np.add.reduceat(n[order].astype(np.int64), first)) / np.log(10)
        each = np.empty(len(order), np.float32)
        each[order] = np.repeat(p, np.diff(np.append(first, len(order))))
        each = ((each.view(np.uint32) + np.uint32(128)) & np.uint32(0xFFFFFF00)).view(np.float32)  # 16 bits of a number are kept
        ends = np.cumsum([m for _, m, _ in held])
        return [(unit, m, _pack(each[end - m : end])) for (unit, m, _), end in zip(held, ends, strict=True)]

    def run(batches):
        held, last = [], None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                unit, kind, shard, n, data = row
                if shard != last and held:
                    yield _rows([(u, 2, last, m, d) for u, m, d in solve(held)])
                    held = []
                last = shard
                if kind == 0:
                    yield _rows([row])
                else:
                    held.append((unit, n, data))
        if held:
            yield _rows([(u, 2, last, m, d) for u, m, d in solve(held)])

    return run


def _gather(batches):
    """Kind 0 and 2 rows, sorted by unit, kind and shard: each unit's documents with the sums of their positions."""
    about, held = None, []

    def done():
        n, data = about
        cut = 8 + int.from_bytes(data[:8], "little")
        log_p = np.concatenate([_unpack(d, m, [np.float32])[0] for m, d in held])[_unpack(data[8:cut], n, [np.uint32])[0]].astype(np.float64)
        lo = 0
        for t in pa.ipc.open_stream(data[cut:]):
            size = t.column("n_tokens").to_numpy()
            ends = np.cumsum(size)
            sums = np.add.reduceat(log_p[lo : lo + int(ends[-1])], ends - size)
            lo += int(ends[-1])
            yield t.set_column(5, "model", pa.array(t.column("model").to_numpy() + sums))

    for b in batches:
        for kind, n, data in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if kind == 0:
                if about is not None:
                    yield from done()
                about, held = (n, data), []
            else:
                held.append((n, data))
    if about is not None:
        yield from done()


def _summed(docs: DataFrame, shared, shards: int) -> DataFrame:
    solved = _units(docs, shared, shards).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "unit").mapInArrow(_solve(shared), _ABOUT)
    both = solved.repartition(shards, "unit").sortWithinPartitions("unit", "kind", "shard")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_gather, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, cold array<long>")


def score(docs: DataFrame) -> DataFrame:
    """op6: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Null and empty texts are one end. Repeated rows count as often as they
    occur and get equal scores; an empty table gives an empty result; other
    columns are not looked at. Long texts are taken whole: a unit ends after
    the document that fills it. Frequent tokens are looked up in the tasks; the
    others' counts are joined by their hash, none frequent enough to be skewed.
    """
    spark = docs.sparkSession
    counts = written(token_counts(docs))
    n, v, ends = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("h") == 0, F.col("c")))).first())
    h, c = most_frequent(counts.filter("h <> 0"), "h", "c", HEAD)
    head = Head(h.view(np.uint64), c, ends, v)
    head.close(_rest_mass(counts, spark.sparkContext.broadcast(head)))
    shared = spark.sparkContext.broadcast(head)
    shards = max(1, math.ceil(n * FOLDS / (FOLDS - 1) / SHARD))
    release(spark)
    rows = written(_summed(docs, shared, shards).withColumn("rid", F.monotonically_increasing_id()))
    release(spark)
    cold = rows.select("rid", F.explode("cold").alias("h"))
    logs = cold.join(counts, "h").groupBy("rid", "c").agg(F.count(F.lit(1)).alias("k"))
    # whole multiples of a fixed step, so that the sum has no order
    more = F.sum(F.round(F.log10(F.col("c") + 1) * (1 << 36)).cast("long") * F.col("k")) / float(1 << 36)
    logs = logs.groupBy("rid").agg(more.alias("more"), F.sum("k").alias("found"))
    out = rows.drop("cold").join(logs, "rid", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    log_all = float(np.log10(n + v + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"),
    )
