"""Toxicity by subword-bag embeddings and a linear softmax.

A segment of ``SEGMENT`` words is the average of the vectors of its words'
character n-grams (over bytes, word edges included, hashed to buckets); a
two-class softmax over that average and the vectors are trained jointly. A
document is as toxic as its most toxic segment, so its length doesn't dilute
a few words. Labels mark documents, not segments: training starts from all
segments of toxic documents and then keeps, round by round, those that the
model finds most toxic. Misspelt or unseen words share n-gram vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import own_names, written
from .textbytes import chunks

SEGMENT, BUCKETS, DIM, GRAMS = 6, 1 << 18, 8, (3, 4, 5, 6)
#: The classifier's bounded sample of labelled rows, of each label: rows with the smallest hashes of their ids, as many as
#: this, and until their whole texts have so many characters (the last text may go beyond).
SAMPLE, SAMPLE_CHARS = {1: 1250, 0: 4000}, {1: 5_000_000, 0: 8_000_000}
#: Bytes of the sample that are cut into n-grams at a time: bounds the driver's memory.
SAMPLE_CHUNK = 1 << 18
#: Every so many texts of the sample set the scale and threshold only.
CALIBRATE = 5
HELD_OUT = 5

_CODE = np.zeros(256, np.uint32)
_CODE[48:58], _CODE[97:123], _CODE[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offs: np.ndarray):
    """Codes with a gap around every row, each row's segments, and per n the buckets and which positions hold an n-gram.

    Returns (segment starts, segments' row offsets, [(bucket, valid)]).
    """
    rows = len(offs) - 1
    code = np.zeros(len(data) + rows + 1 + max(GRAMS), np.uint32)
    at = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offs))
    code[at] = _CODE[data]
    gap = code == 0
    starts = np.flatnonzero(~gap[1:] & gap[:-1])  # the gap before each word
    row = np.searchsorted(starts, offs + np.arange(rows + 1))
    index = np.arange(len(starts)) - np.repeat(row[:-1], np.diff(row))
    first = np.flatnonzero(index % SEGMENT == 0)
    segments, seg_row = starts[first], np.searchsorted(first, row)
    out, h, inner = [], code.copy(), np.ones(len(code), bool)
    n = len(code)
    for k in range(1, max(GRAMS)):
        h[: n - k] = h[: n - k] * np.uint32(0x01000193) + code[k:]
        if k >= 2:
            inner[: n - k + 1] &= ~gap[k - 1 :]
        if k + 1 in GRAMS:
            valid = inner.copy()
            valid[n - k :] = False
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            out.append(((x >> np.uint32(32 - 18)).astype(np.int32), valid))
    return segments, seg_row, out


class Model:
    """vectors (BUCKETS, DIM), softmax weights (DIM, 2) and bias (2)."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
        self.weights = (rng.standard_normal((DIM, 2)) / np.sqrt(DIM)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def calibrate(self, z: np.ndarray, toxic: np.ndarray) -> None:
        """Scale and shift of the documents' logits, by logistic regression (damped Newton steps)."""
        if not len(z) or toxic.min() == toxic.max():
            return
        x, w = np.stack([z / z.std(), np.ones(len(z))], 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - toxic) + 0.02 * w
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2), grad).clip(-2, 2)
        if w[0] > 0:
            self.scale, self.shift = float(w[0] / z.std()), float(w[1])

    def logit_table(self) -> tuple[np.ndarray, float]:
        """The averages are linear: one number per bucket, and a bias, give a segment's logit."""
        w = self.weights[:, 1] - self.weights[:, 0]
        return (self.vectors @ w * self.scale).astype(np.float32), float((self.bias[1] - self.bias[0]) * self.scale + self.shift)

    def fit(self, flat: np.ndarray, at: np.ndarray, use: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int, rate: float = 0.4, size: int = 2048, seed: int = 7) -> None:
        """Mini-batch gradients of the weighted cross entropy, with AdaGrad steps; ``use``: the segments taken, labels and weights: theirs."""
        rng = np.random.default_rng(seed)
        g_vec, g_w, g_b = np.full((BUCKETS, DIM), 1e-3, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(use))
            for lo in range(0, len(order), size):
                pick = order[lo : lo + size]
                first, n = at[use[pick]], at[use[pick] + 1] - at[use[pick]]
                ends = np.cumsum(n)
                ids = flat[np.repeat(first - ends + n, n) + np.arange(ends[-1])]
                who = np.repeat(np.arange(len(pick)), n)
                mean = np.add.reduceat(self.vectors[ids], ends - n, axis=0) / n[:, None]
                z = mean @ self.weights + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), labels[pick]] -= 1
                p *= weights[pick][:, None] / len(pick)
                gw, gb = mean.T @ p, p.sum(0)
                back = ((p @ self.weights.T) / n[:, None]).astype(np.float32)
                uniq, inv = np.unique(ids, return_inverse=True)
                gv = np.stack([np.bincount(inv, back[who, d], len(uniq)) for d in range(DIM)], 1).astype(np.float32) * len(pick)
                g_vec[uniq] += gv**2
                self.vectors[uniq] -= rate * gv / np.sqrt(g_vec[uniq])
                g_w += gw**2
                self.weights -= rate * 0.2 * gw / np.sqrt(g_w)
                g_b += gb**2
                self.bias -= rate * 0.2 * gb / np.sqrt(g_b)


def segment_logits(data: np.ndarray, offs: np.ndarray, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Logit of every segment, and each row's first segment."""
    segments, seg_row, found = grams(data, offs)
    if not len(segments):
        return np.zeros(0), seg_row
    total, count = np.zeros(len(found[0][0])), np.zeros(len(found[0][0]))
    for ids, valid in found:
        total += np.where(valid, table[ids], 0)
        count += valid
    return np.add.reduceat(total, segments) / np.maximum(np.add.reduceat(count, segments), 1) + bias, seg_row


def text_logits(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for lo, hi, data, offs in chunks(texts):
        z, row = segment_logits(data, offs, table, bias)
        has = np.diff(row) > 0
        if has.any():
            best = np.maximum.reduceat(z, row[:-1][has])
            out[np.arange(lo, hi)[has]] = best
    return out


def bags_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram buckets of all segments that have any, each segment's offset (one more at the end) and its text's row."""
    flat, sizes, who = [], [], []
    for lo, hi, data, offs in chunks(texts, SAMPLE_CHUNK):
        segments, row, found = grams(data, offs)
        if not len(segments):
            continue
        pos = np.concatenate([np.flatnonzero(v) for _, v in found])
        ids = np.concatenate([b[v] for b, v in found])
        seg = (np.searchsorted(segments, pos, "right") - 1).astype(np.int32)
        flat.append(ids[np.argsort(seg, kind="stable")])
        n = np.bincount(seg, minlength=len(segments))
        sizes.append(n[n > 0])
        who.append(np.repeat(np.arange(lo, hi), np.diff(row))[n > 0])
    if not flat:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(who)


def bag_logits(flat: np.ndarray, at: np.ndarray, table: np.ndarray, bias: float, size: int = 1 << 14) -> np.ndarray:
    out = np.empty(len(at) - 1)
    for lo in range(0, len(out), size):
        cut = at[lo : lo + size + 1]
        out[lo : lo + size] = np.add.reduceat(table[flat[cut[0] : cut[-1]]], cut[:-1] - cut[0]) / np.diff(cut) + bias
    return out


def train(texts: list[str], toxic: np.ndarray, rounds: int = 4) -> Model:
    """Fits the model to labelled texts; without both labels it stays at a prior."""
    model = Model()
    toxic = np.asarray(toxic, int)
    if not len(toxic) or toxic.min() == toxic.max():
        model.vectors[:] = 0
        model.bias[:] = [3, -3] if not len(toxic) or toxic.max() == 0 else [-3, 3]
        return model
    held = np.arange(len(texts)) % CALIBRATE == 0
    aside, marks = [x for x, h in zip(texts, held, strict=True) if h], toxic[held]
    texts, toxic = [x for x, h in zip(texts, held, strict=True) if not h], toxic[~held]
    flat, segs, who = bags_of(pa.array(texts, pa.string()))
    if not len(who) or toxic.min() == toxic.max():
        return model
    label = toxic[who]
    keep = np.ones(len(who), bool)
    for r in range(rounds):
        use = np.flatnonzero(keep)
        share = label[use].mean()
        weights = np.where(label[use] == 1, min(20.0, 0.25 / max(share, 1e-9)), 1.0)
        model.fit(flat, segs, use, label[use], weights, 1 if r < 2 else 2, seed=7 + r)
        if r == rounds - 1:
            break
        table, bias = model.logit_table()
        z = bag_logits(flat, segs, table, bias)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, who, z)
        keep = (label == 0) | (z >= best[who]) | (z > 1)
    model.calibrate(text_logits(pa.array(aside, pa.string()), *model.logit_table()), marks)
    return model


def bucket(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT))


def _bounded(rows: DataFrame, n: int, chars: int, *order: str) -> DataFrame:
    """The first ``n`` rows by a hash of doc_id, up to the one in which the texts before exceed ``chars``; rows have ``chars``."""
    key = F.xxhash64("doc_id")
    first = rows.orderBy(key, "doc_id", *order).limit(n)
    before = F.sum("chars").over(W.orderBy(key, "doc_id", *order).rowsBetween(W.unboundedPreceding, -1))  # n rows at most
    return first.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < chars).drop("before")


def sample(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None, chars: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, text, toxic): whole labelled texts, at most ``SAMPLE`` of each label and about ``SAMPLE_CHARS`` characters.

    Labels of held-out ids and of ids without a text, null labels and null
    texts aren't used; an id that is marked both toxic and clean counts as
    toxic. Ids are chosen among all rows that have a label and a text.
    """
    learnt = bucket(F.col("doc_id")) != 0
    marks = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & learnt).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & learnt).withColumn("chars", F.length("text"))
    held = written(rows.select("doc_id", "chars").join(marks, "doc_id"))
    parts = []
    for value, n in (most or SAMPLE).items():
        room = (chars or SAMPLE_CHARS)[value]
        chosen = _bounded(held.filter(F.col("toxic") == value), n, room, "chars").select("doc_id", "toxic").distinct()
        parts.append(_bounded(rows.join(F.broadcast(chosen), "doc_id"), n, room, "chars", "text").select("doc_id", "text", "toxic"))
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None) -> tuple[np.ndarray, float]:
    """Logit of every bucket, and a bias, of the model that is trained on the sample.

    One task trains on the bounded sample; the driver only receives one number
    a bucket. Order and result do not depend on how the tables are partitioned.
    """

    def run(batches):
        held = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[2], str(r[0]), r[1]))
        table, bias = train([r[1] for r in held], np.array([r[2] for r in held], int)).logit_table()
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["logits", "bias"])

    got = sample(docs, labels, most).coalesce(1).mapInArrow(run, "logits binary, bias double").first()
    if got is None:  # an empty plan has no task
        return train([], np.zeros(0, int)).logit_table()
    return np.frombuffer(bytes(got["logits"]), np.float32), got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], into: str = "__score") -> DataFrame:
    """``docs`` with the score in ``into``; null and empty texts score the model's prior.

    Every row is scored by itself, whole texts at a time, so repeated rows and
    ties get equal scores; a column named ``into`` is replaced, others are kept.
    """
    table, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = docs.drop(into).withColumn(into, F.lit(0.0)).schema
    where = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            z = text_logits(batch.column(where), shared.value, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, into])

    return docs.drop(into).mapInArrow(run, schema)


@own_names
def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; an empty table stays empty, a column of any name is kept as it is."""
    scored = score(docs, fit(docs, labels))
    return scored.filter(F.col("__score") < threshold).select(*docs.columns)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7: score and prediction of every document."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (bucket(F.col("doc_id")) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
