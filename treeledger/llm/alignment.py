"""Alignment of two tokenizers' tokens by interval coalescing.

The A and B tokens of a text tile the same bytes. All intervals are
lexsorted by start, ``maximum.accumulate`` runs over their ends, and a group
breaks where a start reaches the running maximum: there tokens of both sides
end. Inside the groups overlapping tokens are expanded to links, and the links
of the whole corpus are counted by pair of ids.

A text is cut into units before it is encoded, at spaces that neither
tokenizer's tokens cross, so that both encode and align every distinct unit
of a batch once: a unit's tokens, groups and links are those it has in its
text. No text is shortened.
"""

from __future__ import annotations

import json
import os
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, written

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How a byte-level BPE splits a text before it merges (a fixed value: the rule its file names "ByteLevel").
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are aligned at a time, and units that a task remembers.
SLICE, UNITS = 1 << 22, 1 << 18
#: Characters of a unit beyond which it is encoded apart.
LONG = 1 << 12
#: Pairs of ids whose counts every task holds (17 bytes each); the counts of all others are joined.
HEAD = 1 << 20
#: Links that a task adds up before it passes counts on.
FLUSH = 1 << 22

ADDED = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


class Bytes:
    """A byte-level BPE in one JSON file whose ids follow its merges, so that they are the ranks of its entries."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, plain = model["vocab"], [*range(33, 127), *range(161, 173), *range(174, 256)]
        value = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(value[c] for c in token)
        joins = ((x if isinstance(x, list) else x.split(" ")) for x in model["merges"])
        if any(vocab["".join(x)] != 256 + i for i, x in enumerate(joins)):
            raise ValueError("the ids don't follow the merges")
        ranks = {entry: i for i, entry in enumerate(self.bytes[: 256 + len(model["merges"])])}
        self.path, self.model = path, tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True
        return model

    def encode(self, units: list[str]) -> list[list[int]]:
        """Long units go to the slower of two equal encoders: the other one's stack overflows in very long runs of a character."""
        encode = self.model.encode_ordinary
        return [encode(" " + u) if len(u) <= LONG else self.slow.encode(" " + u, add_special_tokens=False).ids for u in units]


class Pieces:
    """A piece model, which puts a space before the text by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        if any(" " in x.replace("▁", " ").lstrip(" ") for x in names):
            raise ValueError("a piece goes across a space, so texts can't be cut at spaces")

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    return Bytes(path) if path.endswith(".json") else Pieces(path)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each unit has."""
    return np.array(list(chain.from_iterable(ids)), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def _whole(ids: list[list[int]], entries: list[bytes], wanted: list[bytes]) -> np.ndarray:
    """Which units' tokens join to their bytes."""
    got = [b"".join(map(entries.__getitem__, x)) for x in ids]
    return np.ones(len(ids), bool) if got == wanted else np.array([g == w for g, w in zip(got, wanted, strict=True)], bool)


def gathered(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of all runs of ``n`` from ``starts``, one run after the other."""
    ends = np.cumsum(n)
    return np.repeat(starts - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def coalesce(a_start, a_end, b_start, b_end):
    """The order of all A and B tokens by start, and which of them begin a group."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat([0, 1], [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, side, breaks


class Store:
    """The units a task has aligned: per unit its numbers of tokens, groups and links, its groups as text and its pairs of ids."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        self.width = len(b.bytes)
        self.long = [np.array([len(x) for x in t.bytes], np.int64) for t in (a, b)]
        self.names = [[sep + str(i) for i in range(max(len(a.bytes), len(b.bytes)))] for sep in ("", ";", "|", ",")]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.good = np.zeros(0, bool)
        self.first = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def codes(self, units: list[str]) -> np.ndarray:
        """The units' places here; new ones are encoded and aligned."""
        new = [u for u in dict.fromkeys(units) if u not in self.index]
        if new:
            for i, u in enumerate(new, len(self.text)):
                self.index[u] = i
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def _add(self, units: list[str]) -> None:
        a, b = self.a.encode(units), self.b.encode(units)
        wanted = [b" " + u.encode() for u in units]
        good = _whole(a, self.a.bytes, wanted) & _whole(b, self.b.bytes, wanted)
        if not good.all():
            a = [x if g else [] for x, g in zip(a, good, strict=True)]
            b = [x if g else [] for x, g in zip(b, good, strict=True)]
        (a_ids, n_a), (b_ids, n_b) = _flat(a), _flat(b)
        a_end, b_end = np.cumsum(self.long[0][a_ids]), np.cumsum(self.long[1][b_ids])
        a_start, b_start = a_end - self.long[0][a_ids], b_end - self.long[1][b_ids]
        order, side, breaks = coalesce(a_start, a_end, b_start, b_end)
        unit = np.concatenate([np.repeat(np.arange(len(units)), n) for n in (n_a, n_b)])
        n_groups = np.bincount(unit[order][breaks], minlength=len(units))
        # overlaps: of an A token with the B tokens that end after its start and start before its end
        low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        over = high - low
        pairs = np.repeat(a_ids, over) * self.width + b_ids[gathered(low, over)]
        n_links = np.bincount(np.repeat(unit[: len(a_ids)], over), minlength=len(units))
        self._write(np.concatenate([a_ids, b_ids]), unit, side, order, breaks, len(units))
        at = len(self.pairs) + np.cumsum(n_links) - n_links
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.good, self.first = np.concatenate([self.good, good]), np.concatenate([self.first, at])
        self.pairs = np.concatenate([self.pairs, pairs])

    def _write(self, ids, unit, side, order, breaks, n: int) -> None:
        """Each unit's groups: A ids, a bar, B ids; semicolons between groups."""
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks)
        line = np.lexsort((np.arange(len(ids)), side, group))
        g, s, u = group[line], side[line], unit[line]
        sep = np.full(len(line), 3)
        sep[1:][s[1:] != s[:-1]] = 2
        fresh = np.ones(len(line), bool)
        fresh[1:] = g[1:] != g[:-1]
        sep[fresh] = 1
        new = np.ones(len(line), bool)
        new[1:] = u[1:] != u[:-1]
        sep[new] = 0
        names = self.names
        said = [names[k][i] for k, i in zip(sep.tolist(), ids[line].tolist(), strict=True)]
        ends = np.cumsum(np.bincount(u, minlength=n)).tolist()
        self.text += ["".join(said[lo:hi]) for lo, hi in zip([0, *ends], ends)]  # noqa: B905


def units_of(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The texts' units and each text's offset in them (one more at the end); no text is null or empty.

    A unit is what stands after a space and before the next one. It is joined
    to the unit before if one of them is empty (runs of spaces) or white space
    stands on both sides of the cut, since tokens may go across those.
    """
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    offs = np.asarray(split.offsets).astype(np.int64)
    offs = offs - offs[0]
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    empty = np.fromiter((not w for w in words), bool, len(words))
    opens = np.fromiter((w[:1].isspace() for w in words), bool, len(words))
    shuts = np.fromiter((w[-1:].isspace() for w in words), bool, len(words))
    joined = np.zeros(len(codes), bool)
    here, before = codes[1:], codes[:-1]
    joined[1:] = empty[here] | empty[before] | (shuts[before] & opens[here])
    joined[offs[:-1]] = False
    if not joined.any():
        return [words[c] for c in codes.tolist()], offs
    starts = np.flatnonzero(~joined)
    ends = np.append(starts[1:], len(codes))
    listed = codes.tolist()
    out = [words[listed[lo]] if hi - lo == 1 else " ".join([words[c] for c in listed[lo:hi]]) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
    return out, np.searchsorted(starts, offs)


def _slices(texts: pa.Array):
    """Runs of rows with at most ``SLICE`` bytes, or one longer row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, lo = np.concatenate([[0], np.cumsum(size)]), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SLICE, "right")) - 1)
        yield lo, hi
        lo = hi


def _align_slice(texts: pa.Array, store: Store) -> list[pa.Array]:
    """The added columns of some rows."""
    n = len(texts)
    has = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    counts, groups = np.zeros((n, 4), np.int64), [""] * n
    row, pair, times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if has.any():
        if len(store.text) > UNITS:
            store.clear()
        units, offs = units_of(texts.filter(pa.array(has)))
        codes = store.codes(units)
        good = np.logical_and.reduceat(store.good[codes], offs[:-1])
        where = np.flatnonzero(has)
        for c in range(4):
            counts[where, c] = np.where(good, np.add.reduceat(store.counts[codes, c], offs[:-1]), 0)
        said, listed = store.text.__getitem__, codes.tolist()
        for i, g, lo, hi in zip(where.tolist(), good.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            if g:
                groups[i] = ";".join(map(said, listed[lo:hi]))
        doc = np.repeat(np.where(good, where, -1), np.diff(offs))
        codes, doc = codes[doc >= 0], doc[doc >= 0]
        links = store.counts[codes, 3]
        found = store.pairs[gathered(store.first[codes], links)]
        order = np.lexsort((found, np.repeat(doc, links)))
        row, pair = np.repeat(doc, links)[order], found[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(row)))
        row, pair = row[at], pair[at]
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
    return [*(pa.array(counts[:, c]) for c in range(4)), pa.array(groups, pa.string()), pa.ListArray.from_arrays(ends, pa.array(pair)), pa.ListArray.from_arrays(ends, pa.array(times))]


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text: str = "text") -> DataFrame:
    """``docs`` with the alignment of each text: n_a, n_b (tokens), n_groups, n_links, groups, pairs and times.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (ids in order); ``pairs`` holds the
    distinct linked ids as ``a * (size of B's vocabulary) + b`` in order and
    ``times`` how many links each has. Null and empty texts, and those that a
    tokenizer doesn't give back byte by byte (B writes U+2581 for a space),
    have no tokens: zeros, an empty string, empty arrays. Rows are aligned one
    by one, whole, so repeated rows get equal results and an empty table stays
    empty. Columns named like the added ones are replaced, others are kept.
    Both files must be readable on every executor.
    """
    kept = docs.drop(*ADDED)
    schema = kept
    for name, kind in zip(ADDED, ["long"] * 4 + ["string", "array<long>", "array<long>"], strict=True):
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    schema = schema.schema
    at = kept.columns.index(text)

    def run(batches):
        store = Store(_tokenizer(a_file), _tokenizer(b_file))
        for batch in batches:
            for lo, hi in _slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *_align_slice(part.column(at), store)], names=schema.names)

    return kept.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus each pair has, and whether no other pair of its B id has more.

    Tasks add up their own links before the shuffle; the highest counts of the
    B ids (``b_size`` rows at most) are broadcast.
    """

    def run(batches):
        keys, values, held = [], [], 0

        def summed():
            pair, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(values)).astype(np.int64)  # below 2**53
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for batch in batches:
            keys.append(batch.column(0).flatten().to_numpy())
            values.append(batch.column(1).flatten().to_numpy())
            held += len(keys[-1])
            if held > FLUSH:
                yield summed()
                keys, values, held = [], [], 0
        if held:
            yield summed()

    counts = written(aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))
    return written(counts.withColumn("b", F.col("pair") % b_size).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def linked(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` without pairs and times, with n_best (links whose pair is a best one) and count_sum (counts over links).

    The counts of the most frequent pairs, ``head`` at most, are broadcast to
    look most links up in place. The pairs of a row that aren't among them go
    through a join on the pair, whatever their number; none of those pairs is
    frequent, so no key of the join is hot.
    """
    spark = aligned.sparkSession
    keys, marks = most_frequent(counts.select("pair", (F.col("n") * 2 + F.col("best").cast("long")).alias("mark")), "pair", "mark", head)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], marks[order]))
    columns = [c for c in aligned.columns if c not in ("pairs", "times")]
    kinds = aligned.select(*columns, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "pairs", "times").schema

    def run(batches):
        known, mark = shared.value
        for batch in batches:
            pairs, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times"))
            pair, n, rows = pairs.flatten().to_numpy(), times.flatten().to_numpy(), batch.num_rows
            row = np.repeat(np.arange(rows), pc.list_value_length(pairs).to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            got = np.where(found, mark[at], 0) if len(known) else np.zeros(len(pair), np.int64)
            best, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(best, row, n * (got & 1))
            np.add.at(total, row, n * (got >> 1))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=rows))]), pa.int32())
            rest = [pa.ListArray.from_arrays(ends, pa.array(x[~found])) for x in (pair, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(best), pa.array(total), *rest], names=kinds.names)

    own = written(aligned.select(*columns, "pairs", "times").mapInArrow(run, kinds).withColumn("__row", F.monotonically_increasing_id()))
    out = [*columns, "n_best", "count_sum"]
    whole = own.filter(F.size("pairs") == 0).select(*out)
    torn = own.filter(F.size("pairs") > 0)
    rare = torn.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("__row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = rare.join(counts, "pair").groupBy("__row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    added = torn.join(more, "__row").withColumn("n_best", F.col("n_best") + F.col("__best")).withColumn("count_sum", F.col("count_sum") + F.col("__sum"))
    return whole.unionByName(added.select(*out))


def alignment_digest(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, head: int = HEAD) -> DataFrame:
    """op11: every document's numbers of tokens, groups and links, its links' counts and the hash of its groups.

    A null doc_id is kept; a row without tokens has zeros and ''.
    """
    got = align(docs.select("doc_id", "text"), a_file, b_file)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    held = written(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"))
    counts = pair_counts(held, len(_tokenizer(b_file).bytes))
    return linked(held, counts, head).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
