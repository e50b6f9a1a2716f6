"""Near-duplicate join: all pairs of texts whose 5-word shingle sets have a Jaccard similarity of 0.75 or more.

1. Every text becomes its set of shingle hashes; texts with equal sets are one
   class from here on.
2. Shingles get a global order, rare before frequent: the document frequencies
   of all shingles are counted, and the most frequent ones (``HEAD``) come
   last, by frequency; any order gives the right result, this one keeps lists
   short.
3. Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of
   each. Classes that meet in such a list, with sizes and positions that can
   link, fall into one candidate group.
4. Inside a group, blocks of sets are joined by a trie over their globally
   ordered shingles: sets with a common prefix are compared together, and a
   subtree is left when the elements that remain cannot reach the overlap.
   Links join components; comparisons inside one component are skipped.
   Groups beyond a block are first cut by prefixes in the exact order inside
   the group; what is still beyond is joined block by block, in tiles.
"""

from __future__ import annotations

import sys
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, own_names, release, written
from .components import components
from .textbytes import Tokens, chunks, mix64, shingles

WORDS, NUM, DEN = 5, 3, 4
#: Frequent shingles kept on the driver (16 bytes each), grown with the input up to the second number.
HEAD, HEAD_MOST, HEAD_DF = 1 << 16, 1 << 21, 8
#: Sets in a block, and about how many shingles; most text hashes that are broadcast when sets are fetched again.
BLOCK, BLOCK_SHINGLES, BROADCAST_ROWS = 256, 150_000, 2_000_000
#: Shingles of wide groups in a bucket when their candidates are found again.
BUCKET_SHINGLES = 1 << 18
_TOKEN, _RANKED = np.dtype([("h", "<u8"), ("cid", "<i8")]), np.dtype([("c", "<u4"), ("h", "<u8")])
_POSTING = np.dtype([("h", "<u8"), ("fp", "<u8"), ("n", "<u4"), ("p", "<u2")])
_EDGE = np.dtype([("a_fp", "<i8"), ("a_n", "<i8"), ("b_fp", "<i8"), ("b_n", "<i8")])


def _sets(texts: pa.Array, tokens: Tokens):
    """Per chunk: first row, sizes, row of each shingle, shingles (sorted within a row)."""
    for lo, hi, data, offs in chunks(texts):
        h, at = tokens.hashes(data, offs)
        rows, s = shingles(h, at, WORDS)
        yield lo, np.bincount(rows, minlength=hi - lo), rows, s


def _fingerprints(sizes: np.ndarray, rows: np.ndarray, s: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(sizes), np.uint64)
    if len(s):
        has = np.flatnonzero(sizes)
        first = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
        sums[has] = np.add.reduceat(mix64(s), first)
    return mix64(sums + sizes.astype(np.uint64))


def _cut(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each number; 6 still tell the shingles of two sets apart."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _uncut(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _by_bucket(h: np.ndarray, bits: int, rows: np.ndarray) -> pa.RecordBatch:
    """``rows`` (in the order of ``h``) cut into one binary per bucket of the leading bits."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    ends = np.append(cuts[1:], len(bucket))[: len(cuts)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["bucket", "data"])


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, fp) of every row."""

    def run(batches):
        tokens = Tokens()
        for b in batches:
            n, fp = np.zeros(len(b), np.int64), np.zeros(len(b), np.uint64)
            for lo, sizes, rows, s in _sets(b.column(2), tokens):
                n[lo : lo + len(sizes)], fp[lo : lo + len(sizes)] = sizes, _fingerprints(sizes, rows, s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(fp.view(np.int64))], ["doc_id", "th", "n", "fp"])

    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n long, fp long")


def _gathered(parts: list[np.ndarray], dtype, least: int):
    total = sum(map(len, parts))
    return np.concatenate(parts) if total >= least and parts else np.zeros(0, dtype)


def _frequent(texts: DataFrame, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles (their leading bits + 24 bits, sorted) and their frequencies."""

    def count(batches):
        tokens, held, size = Tokens(), [], 0
        for b in batches:
            for _, _, _, s in _sets(b.column(0), tokens):
                held.append(s)
                size += len(s)
                if size > 1_000_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def flush(held):
        """The shingles of some texts, each once and counted: 3 bytes, or 7 with the count in a part of its own."""
        s, n = np.unique(np.concatenate(held), return_counts=True)
        whole = _by_bucket(s[n == 1], bits, _cut(s[n == 1] >> np.uint64(40 - bits), 3))
        more = np.concatenate([_cut(s[n > 1] >> np.uint64(40 - bits), 3), _cut(n[n > 1], 4)], axis=1)
        more = _by_bucket(s[n > 1], bits, more)
        kinds = [pa.array(np.full(len(b), k, np.int32)) for k, b in ((0, whole), (1, more))]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([b.column(0), k, b.column(1)], ["bucket", "kind", "data"]) for k, b in zip(kinds, (whole, more), strict=True)]).combine_chunks().to_batches()[0]

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        once = np.concatenate([np.zeros(0, np.uint64), *(_uncut(x, 3) for x in pdf["data"][pdf["kind"] == 0])])
        more = np.concatenate([np.zeros((0, 7), np.uint8), *(np.frombuffer(x, np.uint8).reshape(-1, 7) for x in pdf["data"][pdf["kind"] == 1])])
        v = np.concatenate([once, _uncut(more[:, :3].tobytes(), 3)])
        n = np.concatenate([np.ones(len(once), np.int64), _uncut(more[:, 3:].tobytes(), 4).astype(np.int64)])
        order = np.argsort(v)
        v, n = v[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.add.reduceat(n, first)
        keep = n >= HEAD_DF
        return pd.DataFrame({"id": (np.int64(key[0]) << 24) | v[first][keep].astype(np.int64), "df": n[keep]})

    counts = written(texts.mapInArrow(count, "bucket int, kind int, data binary").groupBy("bucket").applyInPandas(merge, "id long, df long"))
    ids, df = most_frequent(counts, "id", "df", most)
    ids = ids.view(np.uint64)
    order = np.argsort(ids)
    return ids[order], df[order]


def _edges_of_list(n: np.ndarray, p: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the pairs of a list whose sizes and positions allow a link."""
    m = len(n)
    if m > 4 * BLOCK:  # a superset: neighbours by size
        order = np.argsort(n, kind="stable")
        ok = DEN * n[order[:-1]] >= NUM * n[order[1:]]
        return [(int(a), int(b)) for a, b in zip(order[:-1][ok], order[1:][ok], strict=True)]
    need = -((-NUM * (n[:, None] + n[None, :])) // (NUM + DEN))
    ok = (DEN * np.minimum(n[:, None], n[None, :]) >= NUM * np.maximum(n[:, None], n[None, :])) & (p[:, None] <= n[:, None] - need)
    ok &= ok.T
    out, root = [], list(range(m))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i in range(1, m):
        for j in np.flatnonzero(ok[i, :i]):
            a, b = find(i), find(int(j))
            if a != b:
                root[a] = b
                out.append((i, int(j)))
    return out


def _lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of all lists of a bucket of postings."""
    x = np.concatenate([np.frombuffer(d, _POSTING) for d in pdf["data"]])
    x = x[np.lexsort((x["fp"], x["h"]))]
    new = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["fp"][1:] != x["fp"][:-1])])
    x = x[new]
    first = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]]))
    size = np.diff(np.append(first, len(x)))
    n, p, fp = x["n"].astype(np.int64), x["p"].astype(np.int64), x["fp"]
    two = first[size == 2]
    need = -((-NUM * (n[two] + n[two + 1])) // (NUM + DEN)) if len(two) else np.zeros(0, np.int64)
    ok = (p[two] <= n[two] - need) & (p[two + 1] <= n[two + 1] - need) if len(two) else np.zeros(0, bool)
    a, b = [two[ok]], [two[ok] + 1]
    for f, m in zip(first[size > 2], size[size > 2], strict=True):
        if e := _edges_of_list(n[f : f + m], p[f : f + m]):
            e = np.array(e) + f
            a.append(e[:, 0])
            b.append(e[:, 1])
    a, b = np.concatenate(a), np.concatenate(b)
    swap = fp[a] > fp[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pd.DataFrame({"a_fp": fp[a].view(np.int64), "a_n": n[a], "b_fp": fp[b].view(np.int64), "b_n": n[b]}).drop_duplicates()


def _thinned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings (sorted by h) with long lists cut to one posting of each size, and the edges that span what is cut.

    A shingle that very many sets hold in front so sends few postings of a
    task on. Sets of one size may all link, so each is joined to the one that
    stays; that one takes the first place, where it may link with all others.
    """
    first, ends = _cuts(x["h"]) if len(x) else (np.zeros(0, int), np.zeros(0, int))
    long = ends - first > 4 * BLOCK
    if not long.any():
        return x, np.zeros(0, _EDGE)
    keep, edges = np.ones(len(x), bool), []
    for lo, hi in zip(first[long], ends[long], strict=True):
        order = lo + np.argsort(x["n"][lo:hi], kind="stable")
        f, e = _cuts(x["n"][order])
        stays = np.repeat(order[f], e - f)
        others = order != stays
        out = np.zeros(int(others.sum()), _EDGE)
        a, b = x[stays[others]], x[order[others]]
        swap = a["fp"] > b["fp"]
        out["a_fp"], out["b_fp"] = np.where(swap, b["fp"], a["fp"]).view(np.int64), np.where(swap, a["fp"], b["fp"]).view(np.int64)
        out["a_n"], out["b_n"] = a["n"], b["n"]
        edges.append(out)
        keep[order[others]] = False
        x["p"][order[f]] = 0
    return x[keep], np.concatenate(edges)


def _candidates(texts: DataFrame, bits: int, head: tuple[np.ndarray, np.ndarray], post_bits: int) -> DataFrame:
    """Edges (a_fp, a_n, b_fp, b_n) between classes that may link."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def prefixes(batches):
        tokens, held, size = Tokens(), [], 0
        ids, freq = shared.value
        for b in batches:
            for _, sizes, rows, s in _sets(b.column(0), tokens):
                if not len(s):
                    continue
                fp = _fingerprints(sizes, rows, s)
                at = np.concatenate([[0], np.cumsum(sizes)])
                if len(ids):
                    key = s >> np.uint64(40 - bits)
                    spot = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
                    weight = np.where(ids[spot] == key, freq[spot], 0)
                    order = np.argsort(rows * (int(freq.max()) + 1) + weight, kind="stable")
                    s = s[order]
                pos = np.arange(len(s)) - at[rows]
                keep = pos <= sizes[rows] - (-((-NUM * sizes[rows]) // DEN))
                out = np.zeros(int(keep.sum()), _POSTING)
                out["h"], out["fp"], out["n"], out["p"] = s[keep], fp[rows[keep]], sizes[rows[keep]], np.minimum(pos[keep], 65535)
                held.append(out)
                size += len(out)
                if size > 400_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def flush(held):
        all_ = np.concatenate(held)
        order = np.lexsort((all_["fp"], all_["h"]))
        all_ = all_[order]
        new = np.concatenate([[True], (all_["h"][1:] != all_["h"][:-1]) | (all_["fp"][1:] != all_["fp"][:-1])])
        left, edges = _thinned(all_[new])
        out = _by_bucket(left["h"], post_bits, left)
        spread = int(left["fp"][0] >> np.uint64(33)) if len(left) else 0
        buckets = pa.concat_arrays([out.column(0), pa.array([spread] if len(edges) else [], pa.int32())])
        kinds = pa.array([0] * len(out) + [1] * (len(edges) > 0), pa.int32())
        return pa.RecordBatch.from_arrays([buckets, kinds, pa.concat_arrays([out.column(1), pa.array([edges.tobytes()] if len(edges) else [], pa.binary())])], ["bucket", "kind", "data"])

    def lists(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[1] == 0:
            return _lists(pdf)
        return pd.DataFrame(np.concatenate([np.frombuffer(d, _EDGE) for d in pdf["data"]])).drop_duplicates()

    posted = texts.mapInArrow(prefixes, "bucket int, kind int, data binary").groupBy("bucket", "kind")
    return posted.applyInPandas(lists, "a_fp long, a_n long, b_fp long, b_n long").distinct()


class _Node:
    __slots__ = ("label", "kids", "lo", "hi", "comp", "ends")


def _trie(sets: list[list[int]], who: list[int], comp: list[int]) -> _Node:
    """A compressed trie over ordered sets; each node knows its sets' sizes, and their component if it is one."""
    order = sorted(range(len(sets)), key=lambda i: sets[i])
    s = [sets[i] for i in order]
    w = [who[i] for i in order]

    def build(lo: int, hi: int, depth: int) -> _Node:
        node, a, b, d = _Node(), s[lo], s[hi - 1], depth
        while d < len(a) and d < len(b) and a[d] == b[d]:
            d += 1
        node.label, node.ends, node.kids = a[depth:d], [], []
        i = lo
        while i < hi and len(s[i]) == d:
            node.ends.append(w[i])
            i += 1
        while i < hi:
            j = i + 1
            while j < hi and s[j][d] == s[i][d]:
                j += 1
            node.kids.append(build(i, j, d))
            i = j
        sizes = [len(x) for x in s[lo:hi]] if not node.kids else [k.lo for k in node.kids] + [k.hi for k in node.kids] + [d] * bool(node.ends)
        node.lo, node.hi = min(sizes), max(sizes)
        comps = {k.comp for k in node.kids} | {comp[x] for x in node.ends}
        node.comp = comps.pop() if len(comps) == 1 else None
        return node

    return build(0, len(s), 0)


def trie_links(sets: list[np.ndarray], comps: list[int], probe: list[bool], stored: list[bool]) -> list[tuple[int, int]]:
    """Links between probe and stored sets, as many as it takes to join their components."""
    if len(sets) < 2 or not any(probe) or not any(stored):
        return []
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    uniq, inv, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(uniq), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(uniq))  # what most sets hold comes first: long common paths
    cuts = np.cumsum([len(x) for x in sets])[:-1]
    ordered = [sorted(x.tolist()) for x in np.split(rank[inv], cuts)]
    names = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = [names[c] for c in comps]
    root = list(range(len(names)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    keep = [i for i, x in enumerate(stored) if x]
    top = _trie([ordered[i] for i in keep], keep, comp)
    links = []
    for i in (i for i, x in enumerate(probe) if x):
        xs, nx = ordered[i], len(ordered[i])
        x, stack = set(xs), [(top, 0, 0)]
        while stack:
            node, o, d = stack.pop()
            if DEN * node.hi < NUM * nx or DEN * nx < NUM * node.lo or (node.comp is not None and find(node.comp) == find(comp[i])):
                continue
            miss_y, miss_x = DEN * node.hi - NUM * nx, DEN * nx - NUM * node.lo  # 7 times the misses that a link allows
            at = d
            for r in node.label:
                at += 1
                if r in x:
                    o += 1
                elif 7 * (at - o) > miss_y:
                    break
            else:
                if node.label and 7 * (bisect_right(xs, node.label[-1]) - o) > miss_x:
                    continue
                for y in node.ends:
                    if DEN * o >= NUM * (nx + at - o) and find(comp[y]) != find(comp[i]):
                        root[find(comp[y])] = find(comp[i])
                        links.append((i, y))
                stack.extend((k, o, at) for k in node.kids)
    return links


def _joined(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) of every tile; rows: keys, cid, comp, data, probe, stored."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        links = trie_links([_uncut(x, 6) for x in pdf["data"]], pdf["comp"].tolist(), pdf["probe"].tolist(), pdf["stored"].tolist())
        ids = pdf["cid"].to_numpy()
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    return tiles.groupBy(*keys).applyInPandas(run, "a long, b long")


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.append(first[1:], len(key))


def _refined(wide: DataFrame) -> DataFrame:
    """(cid, g): the groups of (g, cid, data) by prefixes in the exact order of frequency inside a group.

    Long texts that share some passages chain into one large group where the
    order of rare shingles is unknown. With exact counts what only one set
    holds comes first, so a set that can't link has no candidate and is left
    out, and the others fall into groups of sets that resemble each other.
    """
    total = wide.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = min(20, max(6, int(np.ceil(np.log2(max(1, total / 6 / BUCKET_SHINGLES))))))

    def spread(batches):
        for b in batches:
            held, size = [], 0
            for g, cid, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = _uncut(data, 6)
                out = np.zeros(len(s), _TOKEN)
                out["h"], out["cid"] = mix64(s ^ mix64(np.array([g], np.int64).view(np.uint64))), cid
                held.append(out)
                size += len(s)
                if size > 400_000:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    def flush(held):
        all_ = np.concatenate(held)
        return _by_bucket(all_["h"], bits, all_)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(d, _TOKEN) for d in pdf["data"]])
        _, inv, c = np.unique(x["h"], return_inverse=True, return_counts=True)
        out = np.zeros(len(x), _RANKED)
        out["c"], out["h"] = c[inv], x["h"]
        order = np.argsort(x["cid"], kind="stable")
        cid, out = x["cid"][order], out[order]
        first, ends = _cuts(cid)
        return pd.DataFrame({"cid": cid[first], "data": [out[a:b].tobytes() for a, b in zip(first, ends, strict=True)]})

    def prefix(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(d, _RANKED) for d in pdf["data"]])
        x = x[np.lexsort((x["h"], x["c"]))]
        n = len(x)
        x = x[: n + (-NUM * n) // DEN + 1]
        out = np.zeros(len(x), _POSTING)
        out["h"], out["fp"], out["n"], out["p"] = x["h"], key[0], n, np.minimum(np.arange(len(x)), 65535)
        out = out[x["c"] > 1]
        return _by_bucket(out["h"], bits, out).to_pandas()

    ranked = wide.select("g", "cid", "data").mapInArrow(spread, "bucket int, data binary").groupBy("bucket").applyInPandas(counted, "cid long, data binary")
    posted = ranked.groupBy("cid").applyInPandas(prefix, "bucket int, data binary").groupBy("bucket")
    edges = posted.applyInPandas(_lists, "a_fp long, a_n long, b_fp long, b_n long").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    return components(edges).select(F.col("node").alias("cid"), F.col("root").alias("g"))


def _links(sets: DataFrame, small: bool) -> DataFrame:
    """Links that join all components of linked sets; ``sets``: (g, m, w, cid, data), m and w the sets and shingles of group g.

    ``small``: there are at most ``BROADCAST_ROWS`` sets, so their components
    are broadcast to them and the sets themselves are shuffled to tiles only.
    """
    blocks = F.least("m", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES))).cast("int")
    sets = sets.withColumn("k", blocks)
    loose = sets.filter("k > 1").select("g", "cid", "data")
    if not loose.isEmpty():
        held = (lambda x: F.broadcast(x)) if small else (lambda x: x)
        again = loose.drop("g").join(held(written(_refined(loose))), "cid")
        sizes = again.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("data") / 6).cast("long").alias("w"))
        again = again.join(held(written(sizes)), "g").withColumn("k", blocks)
        sets = sets.filter("k <= 1").unionByName(again)
        sets = sets if small else written(sets)
        release(sets.sparkSession)
    sets = sets.withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    own = sets.select("g", "blk", "cid", F.col("cid").alias("comp"), "data", F.lit(True).alias("probe"), F.lit(True).alias("stored"))
    links = written(_joined(own, ["g", "blk"]))
    release(sets.sparkSession)
    wide = sets.filter("k > 1")
    if wide.isEmpty():
        return links

    def marked(found: DataFrame) -> DataFrame:
        roots = written(components(found).withColumnRenamed("node", "cid"))
        return wide.join(F.broadcast(roots) if small else roots, "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")

    # the first block against every other one joins what most blocks have in common
    first = marked(links)
    to = F.explode(F.when(F.col("blk") == 0, F.sequence(F.lit(1), F.col("k") - 1)).otherwise(F.array("blk"))).alias("to")
    star = first.select("g", to, "cid", "comp", "data", (F.col("blk") != 0).alias("probe"), (F.col("blk") == 0).alias("stored"))
    links = written(links.union(_joined(star, ["g", "to"])))
    release(sets.sparkSession)
    # then those outside a group's largest component against all of it
    rest = marked(links) if small else written(marked(links))
    sizes = rest.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("g").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("others"))
    rest = rest.join(F.broadcast(main) if small else main, "g").filter("others > 0").withColumn("j", F.ceil(F.col("others") * F.col("k") / F.col("m")).cast("int"))
    probes = rest.filter("comp <> main").withColumn("pb", F.pmod(F.xxhash64("cid"), F.col("j")).cast("int"))
    probes = probes.select("g", "pb", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("blk"), "cid", "comp", "data", F.lit(True).alias("probe"), F.lit(False).alias("stored"))
    stored = rest.select("g", F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("pb"), "blk", "cid", "comp", "data", F.lit(False).alias("probe"), F.lit(True).alias("stored"))
    return written(links.union(_joined(probes.union(stored), ["g", "pb", "blk"])))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, root) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links. Null and empty
    texts have no shingles, link with nothing and keep their own id; rows with
    a null id link like any other, but give a component no id.
    """
    texts = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = written(_classes(docs))
    classes = rows.filter("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("low"), F.min("th").alias("th"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    shingle_count = rows.agg(F.sum("n")).first()[0] or 0
    bits = min(20, max(6, int(np.ceil(np.log2(max(1, shingle_count / 1e6))))))
    head = _frequent(texts, bits, min(HEAD_MOST, max(HEAD, shingle_count // 512)))
    release(docs.sparkSession)
    edges = _candidates(texts, bits, head, min(20, max(7, bits)))
    name = lambda x: classes.select(F.col("fp").alias(f"{x}_fp"), F.col("n").alias(f"{x}_n"), F.col("cid").alias(x))
    edges = written(edges.join(name("a"), ["a_fp", "a_n"]).join(name("b"), ["b_fp", "b_n"]).select("a", "b"))
    release(docs.sparkSession)
    groups = written(components(edges).select(F.col("node").alias("cid"), F.col("root").alias("g")))
    members = groups.join(classes, "cid")
    members = written(members.join(members.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")), "g").select("g", "m", "w", "cid", "fp", "n", "th"))
    wanted = members.select("th").distinct()
    small = members.count() <= BROADCAST_ROWS
    if small:
        wanted = F.broadcast(wanted)

    def fetch(batches):
        tokens, seen = Tokens(), set()
        for b in batches:
            for _, sizes, rows_, s in _sets(b.column(0), tokens):
                fp = _fingerprints(sizes, rows_, s).view(np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                new = [i for i in np.flatnonzero(sizes) if fp[i] not in seen and not seen.add(fp[i])]
                yield pa.RecordBatch.from_arrays([pa.array(fp[new]), pa.array(sizes[new].astype(np.int64)), pa.array([_cut(s[at[i] : at[i + 1]], 6).tobytes() for i in new], pa.binary())], ["fp", "n", "data"])

    found = docs.select(F.xxhash64("text").alias("th"), "text").join(wanted, "th", "left_semi").select("text").mapInArrow(fetch, "fp long, n long, data binary")
    sets = written(found.groupBy("fp", "n").agg(F.first("data").alias("data")).join(members, ["fp", "n"]).select("g", "m", "w", "cid", "data"))
    release(docs.sparkSession)
    roots = components(_links(sets, small))
    release(docs.sparkSession)
    comp = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lows = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    comp = written(comp.join(lows, "root").select("fp", "n", "component_id", "root"))
    out = rows.join(comp, ["fp", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), own.alias("component_id"), "root")


@own_names
def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then of the smallest text hash.

    Documents without words (null and empty texts among them) link with
    nothing, and all of them stay. Of rows that repeat (doc_id, text) one stays.
    Texts are read whole however long; an empty table stays empty; all columns
    are kept, whatever their names.
    """
    rows = written(near_duplicates(docs.select("doc_id", "text")))
    linked = rows.filter("n_shingles > 0")
    keep = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    same = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("th") == F.col("k.th"))
    gone = written(linked.join(keep, "root").filter(~same).select(F.col("doc_id").alias("__id"), F.col("th").alias("__gone")).distinct())
    again = written(linked.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__gone")))
    held = docs.withColumn("__th", F.xxhash64("text"))

    def without(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right
        return left.join(right, left["doc_id"].eqNullSafe(right["__id"]) & (left["__th"] == right["__gone"]), how)

    kept = without(held, gone, "left_anti")
    if not again.isEmpty():
        once = without(kept, again, "left_semi").dropDuplicates(["doc_id", "__th"])
        kept = without(kept, again, "left_anti").union(once)
    return kept.select(*docs.columns)


def ngram_join_digest(docs: DataFrame) -> DataFrame:
    """op2: per document the size of its shingle set and its component."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
