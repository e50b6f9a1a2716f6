"""Quality rules: a decision list that sequential covering learns from labelled statistics.

Every text is reduced to counts. From a bounded sample of labelled rows, rules
that reject are learnt one after the other: a rule grows by the threshold that
gains most on two thirds of the rows, is pruned from its end on the other
third, and takes the rows it covers with it. The list comes out as one ordered
Spark conditional expression over ratios of the counts, with keeping as its
last branch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textbytes import Tokens, chunks, mix64

WINDOW = 5
#: Labelled rows of each label that the rules are learnt from, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: A rule has to be right on this share of the rows that it covers when it is pruned, and to cover so many when it grows.
PRECISION, LEAST, CONDITIONS = 0.9, 5, 4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "longest_word"]
_TABLES = {"n_symbols": b"#*$%&|<>", "n_digits": b"0123456789", "n_upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules test, from the counts."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "duplicate_lines": _ratio("n_dup_lines", "n_lines"),
        "repeated_words": _ratio("n_repeat_words", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
        "digits": _ratio("n_digits", "word_chars"),
        "capitals": _ratio("n_upper", "word_chars"),
        "longest_word": F.col("longest_word").cast("double"),
    }


def count_texts(texts: pa.Array) -> np.ndarray:
    """(rows, len(COUNTS)): the counts of whole texts; a null text has none of anything."""
    tokens, out = Tokens(fold=False), np.zeros((len(texts), len(COUNTS)), np.int64)
    tables = {k: np.isin(np.arange(256), list(v)) for k, v in _TABLES.items()}
    for lo, hi, data, offs in chunks(texts):
        part = out[lo:hi]
        put = lambda name, values, part=part: part.__setitem__((slice(None), COUNTS.index(name)), values)
        between = lambda marks, offs=offs: np.diff(np.concatenate([[0], np.cumsum(marks)])[offs])
        starts, ends, at = tokens.spans(data, offs)
        n = np.diff(at)
        put("n_words", n)
        point = (data & 0xC0) != 0x80
        put("word_chars", between(tokens.inside[data] & point))
        for name, table in tables.items():
            put(name, between(table[data]))
        breaks = np.flatnonzero(data == 10)
        line_starts = np.union1d(breaks + 1, offs[:-1])
        line_starts = line_starts[line_starts < len(data)]
        row = np.searchsorted(offs, line_starts, "right") - 1
        line_ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)], offs[row + 1])
        worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends, row = line_starts[worded], line_ends[worded], row[worded]
        words, lines = tokens.of_spans(data, (starts, ends), (line_starts, line_ends))
        put("n_lines", np.bincount(row, minlength=hi - lo))
        put("n_dup_lines", np.bincount(row[_seen(row, lines)[0]], minlength=hi - lo))
        put("n_repeat_words", _repeated(words, at))
        if len(starts):
            length = np.diff(np.concatenate([[0], np.cumsum(point)])[np.stack([starts, ends])], axis=0)[0]
            has = n > 0
            part[has, COUNTS.index("longest_word")] = np.maximum.reduceat(length, at[:-1][has])
    return out


def _seen(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (row, value) stood before, and which stand twice or more."""
    order = np.lexsort((np.arange(len(row)), value, row))
    same = np.zeros(len(row) + 1, bool)
    same[1:-1] = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    later, twice = np.zeros(len(row), bool), np.zeros(len(row), bool)
    later[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return later, twice


def _repeated(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row, the words in windows of ``WINDOW`` words that stand twice or more in the row."""
    rows, n = len(at) - 1, len(words)
    row = np.repeat(np.arange(rows), np.diff(at))
    first = np.flatnonzero(np.arange(n) + WINDOW <= at[1:][row]) if n else np.zeros(0, np.int64)
    value = np.zeros(len(first), np.uint64)
    for j in range(WINDOW):
        value = mix64(value * np.uint64(0xC2B2AE3D27D4EB4F) + words[first + j])
    hit = first[_seen(row[first], value)[1]]
    cover = np.cumsum(np.bincount(hit, minlength=n + 1) - np.bincount(hit + WINDOW, minlength=n + 1)[: n + 1])[:n] > 0
    return np.bincount(row[cover], minlength=rows)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text; columns of their names are replaced, others are kept.

    A null text counts as an empty one. Rows are counted one by one, so
    repeated rows get equal counts and an empty table stays empty.
    """
    kept = docs.drop(*COUNTS)
    schema = kept.select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    at = kept.columns.index(text)

    def run(batches):
        for batch in batches:
            counts = count_texts(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], names=schema.names)

    return kept.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, at least?, threshold) that hold together for a text to be rejected; right of covered rows of the sample."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    right: int

    def column(self, values: dict[str, Column]) -> Column:
        held = F.lit(True)
        for name, above, x in self.conditions:
            held = held & ((values[name] >= x) if above else (values[name] <= x))
        return held

    def mask(self, values: np.ndarray, names: list[str]) -> np.ndarray:
        held = np.ones(len(values), bool)
        for name, above, x in self.conditions:
            v = values[:, names.index(name)]
            held &= (v >= x) if above else (v <= x)
        return held

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<='} {x:.6g}" for n, up, x in self.conditions)


def _best(values: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, tuple[str, bool, float] | None]:
    """The threshold with the highest gain: p * (log2 precision after - log2 precision before)."""
    before = np.log2(max(bad.mean(), 1e-12))
    best, found = 1e-9, None
    for i, name in enumerate(names):
        order = np.argsort(values[:, i], kind="stable")
        v, p = values[order, i], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1])  # between rows cut and cut + 1
        if not len(cut):
            continue
        for above in (True, False):
            right = (p[-1] - p[cut]) if above else p[cut]
            covered = (len(v) - 1 - cut) if above else cut + 1
            ok = (right > 0) & (covered >= LEAST)
            gain = np.where(ok, right * (np.log2(np.maximum(right, 1) / covered) - before), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), (name, above, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    return best, found


def learn(values: np.ndarray, bad: np.ndarray, aside: np.ndarray, names: list[str]) -> list[Rule]:
    """Rules that reject, in order. ``aside``: the rows that prune. Without rows of both labels there are none."""
    rules, left, bad = [], np.ones(len(bad), bool), np.asarray(bad, bool)
    while True:
        grow, prune = left & ~aside, left & aside
        if bad[grow].sum() < LEAST or not (~bad[left]).any():
            return rules
        conditions, held = [], grow.copy()
        while (~bad[held]).any() and len(conditions) < CONDITIONS:
            gain, found = _best(values[held], bad[held], names)
            if found is None:
                break
            conditions.append(found)
            held &= Rule((found,), 0, 0).mask(values, names)
        scored = []
        for k in range(len(conditions), 0, -1):
            hit = prune & Rule(tuple(conditions[:k]), 0, 0).mask(values, names)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            scored.append(((p - n) / (p + n) if hit.any() else -1.0, -k, k, p, n))
        if not scored:
            return rules
        _, _, k, p, n = max(scored)
        rule = Rule(tuple(conditions[:k]), 0, 0)
        hit = left & rule.mask(values, names)
        if p + n == 0 or p < PRECISION * (p + n) or (hit & bad).sum() < PRECISION * hit.sum():
            return rules
        rules.append(Rule(rule.conditions, int(hit.sum()), int((hit & bad).sum())))
        left &= ~hit


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn_rules(counted: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``most`` labelled rows of each label that don't fail the base rules.

    ``quality`` 1 is good, 0 is bad; other and null labels aren't used, an id
    with both counts as good. The driver gets the rows' ratios only.
    """
    values = features()
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    key = F.xxhash64("doc_id")
    rows = counted.filter(~base_failed()).join(marks, "doc_id").select("doc_id", "quality", *[v.alias(f"f_{k}") for k, v in values.items()])
    names = [f"f_{k}" for k in values]
    parts = [rows.filter(F.col("quality") == q).orderBy(key, *rows.columns).limit(most) for q in (0, 1)]
    got = parts[0].unionByName(parts[1]).withColumn("aside", F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).toArrow()
    held = np.stack([got.column(n).to_numpy() for n in names], 1) if got.num_rows else np.zeros((0, len(names)))
    return learn(held, got.column("quality").to_numpy() == 0, got.column("aside").to_numpy(), list(values))


def fired(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does. The ordered conditional of the whole list."""
    values, out = features(), None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(values), i) if out is None else out.when(rule.column(values), i)
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def judge(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """``counted`` with base_failed, rule (the rule that rejects, else null) and kept."""
    return counted.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), fired(rules))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op13: counts and verdict of every document; ``rule`` numbers the rule that rejected it."""
    counted = written(statistics(docs.select("doc_id", "text")).drop("text"))
    return judge(counted, learn_rules(counted, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
