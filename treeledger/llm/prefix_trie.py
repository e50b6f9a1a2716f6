"""The prefix trie of conversations by van Emde Boas recursion over depths.

Sequences are cut at half of the greatest depth (a power of two), the cut
prefixes are named, and the upper trie and the forests below the named cuts
are cut in the same way, all of them in parallel:

* names: blocks of 1, 2, 4, ... turns are named by the names of their halves,
  then cut prefixes from the greatest cut down by the name of the shorter cut
  prefix and of the block that follows it. After log2(depth) rounds every
  prefix of every conversation has a name, and equal prefixes have equal ones;
* totals: a node's total over its own block of depths grows from blocks of 1,
  2, 4, ... levels: what the forest below a cut holds is grafted onto the cut
  and its ancestors in the upper block.

Rows are (conversation, depth), never whole conversations, so that neither a
very long conversation nor a very common prefix meets in one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_tokens, written

#: Turns that are taken over from the first conversation of each run of ``RUN`` ids: crc32(id) mod HEADS.
RUN, HEADS = 20, 4
#: Characters of a list of ids that go to a hash at a time.
PIECE = 1 << 16


def _name(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of some names, which are of fixed length, or of a turn."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, sym, words): each conversation's turns from 1, their names and how many words they have.

    Turns are in order of ``turn``, null first; turns with equal numbers are in
    order of the hash of role and text, so repeated rows are turns of their
    own, side by side. Null roles and texts are empty; rows without conv_id
    take no part. Rows are dealt by ranges of this order, in which even equal
    rows are told apart; only the conversation that a range begins with can
    have turns in ranges before, one number a range.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sym = _name(F.length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), sym.alias("sym"), n_tokens(text).alias("words"))
    dealt = written(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "sym", "tie").withColumn("range", F.spark_partition_id()))
    held = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    torn = held.withColumn("before", before).filter("before > 0").select("conv_id", "range", "before")
    inside = F.row_number().over(W.partitionBy("conv_id", "range").orderBy("turn", "sym", "tie")).cast("long")
    placed = dealt.withColumn("inside", inside).join(F.broadcast(torn), ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("pos"), "sym", "words")


def heads_taken(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, pos, sym, words), and (conv_id, depth) of all, turnless ones too.

    Conversation c is the first h turns of conversation c - c mod RUN (fewer if
    it has fewer, none if it isn't there), then its own turns after its first h.
    """
    sizes = numbered.groupBy("conv_id").agg(F.max("pos").alias("own"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = sizes.withColumn("h", heads_taken(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % RUN)
    convs = written(convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).select("conv_id", "own", "h", "base", "taken"))
    depth = (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("depth")
    fewer = convs.filter("taken < h").select("conv_id", "taken")
    h = heads_taken(F.col("conv_id"))
    own = numbered.filter(F.col("pos") > h).join(fewer, "conv_id", "left").withColumn("pos", F.col("pos") - h + F.coalesce("taken", h)).select("conv_id", "pos", "sym", "words")
    first = numbered.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    head = convs.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter("pos <= taken").select("conv_id", "pos", "sym", "words")
    return own.unionByName(head), convs.select("conv_id", depth)


def named(seqs: DataFrame, levels: int) -> DataFrame:
    """``seqs`` (conv_id, pos, sym, words) with ``node``, the name of the sequence's first ``pos`` turns.

    ``levels``: log2 of the greatest depth, rounded up. No key of the joins has
    more than one row on either side.
    """
    blocks = [seqs.select("conv_id", (F.col("pos") - 1).alias("i"), F.col("sym").alias("name"))]
    for _ in range(levels):  # names of blocks of 2, 4, ... turns; only whole blocks are needed
        halves = blocks[-1].withColumn("left", F.when(F.col("i") % 2 == 0, F.col("name"))).withColumn("right", F.when(F.col("i") % 2 == 1, F.col("name")))
        pairs = halves.groupBy("conv_id", F.floor(F.col("i") / 2).cast("long").alias("i")).agg(F.max("left").alias("left"), F.max("right").alias("right"))
        blocks.append(written(pairs.filter("left IS NOT NULL AND right IS NOT NULL").select("conv_id", "i", _name(F.col("left"), F.col("right")).alias("name"))))
    cuts = None  # named prefixes (conv_id, pos, node); pos is a multiple of the block size
    for j in reversed(range(levels + 1)):
        follow = blocks[j].filter(F.col("i") % 2 == 0).select("conv_id", (F.col("i") * 2**j).alias("at"), ((F.col("i") + 1) * 2**j).alias("pos"), "name")
        root = _name(F.lit("root").cast("binary"), F.col("name"))
        if cuts is None:
            new = follow.select("conv_id", "pos", root.alias("node"))
        else:
            up = cuts.select("conv_id", F.col("pos").alias("at"), "node")
            new = follow.join(up, ["conv_id", "at"], "left").select("conv_id", "pos", F.when(F.col("at") == 0, root).otherwise(_name(F.col("node"), F.col("name"))).alias("node"))
        cuts = written(new) if cuts is None else cuts.unionByName(written(new))
    return seqs.join(cuts, ["conv_id", "pos"])


def hashed_lists(ends: DataFrame, key: str = "node", value: str = "conv_id") -> DataFrame:
    """(key, sha): the SHA-256 of each key's values, ascending, in decimal and joined by commas.

    Rows are sorted over ranges. A key that lies inside one range is hashed
    there; the pieces of one that goes over several meet in order in one task,
    as text that is hashed piece by piece: the hash is sequential, but nothing
    is held whole.
    """

    def part(batches):
        """Pieces (key, range, seq, text) of the range's first and last key and of long lists; hashes of those between."""
        from pyspark import TaskContext

        at, now, first, seq, size, texts = TaskContext.get().partitionId(), None, True, 0, 0, []
        kind = pa.schema([(key, pa.binary()), ("range", pa.int32()), ("seq", pa.int64()), ("text", pa.string()), ("sha", pa.string())])

        def row(inside: bool) -> dict:
            text = ",".join(texts)
            sha = hashlib.sha256(text.encode()).hexdigest() if inside and seq == 0 else None
            return {key: now, "range": at, "seq": seq, "text": None if sha else text, "sha": sha}

        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        out.append(row(not first))
                        first = False
                    now, texts, seq, size = k, [], 0, 0
                texts.append(str(v))
                size += len(texts[-1]) + 1
                if size >= PIECE:
                    out.append(row(False))
                    texts, size, seq = [], 0, seq + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([row(False)], kind)

    def whole(batches):
        now, sha, begun = None, None, False
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        out.append({key: now, "sha": sha.hexdigest()})
                    now, sha, begun = k, hashlib.sha256(), False
                if text:
                    sha.update((("," if begun else "") + text).encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([(key, pa.binary()), ("sha", pa.string())]))
        if now is not None:
            yield pa.RecordBatch.from_pylist([{key: now, "sha": sha.hexdigest()}], pa.schema([(key, pa.binary()), ("sha", pa.string())]))

    kinds = f"{key} binary, range int, seq long, text string, sha string"
    parts = written(ends.select(key, value).repartitionByRange(key, value).sortWithinPartitions(key, value).mapInArrow(part, kinds))
    torn = parts.filter("sha IS NULL").repartition(key).sortWithinPartitions(key, "range", "seq").select(key, "text")
    return parts.filter("sha IS NOT NULL").select(key, "sha").unionByName(torn.mapInArrow(whole, f"{key} binary, sha string"))


def grafted(nodes: DataFrame, members: DataFrame, levels: int, totals: list[str]) -> DataFrame:
    """(node, \\*totals): each node's ``totals`` summed over its subtree, by grafting blocks of depths.

    nodes: node, depth, parent, conv_id (a member), totals; members: conv_id,
    pos, node. In round j every node whose depth begins the lower half of a
    block of 2**(j+1) levels gives its sum over that half to its parent, the
    cut, and to the cut's ancestors in the upper half.
    """
    sums = [F.sum(c).alias(c) for c in totals]
    held = nodes.select("node", "depth", "parent", "conv_id", *totals)
    for j in range(levels):
        below = held.filter((F.floor((F.col("depth") - 1) / 2**j) % 2 == 1) & ((F.col("depth") - 1) % 2**j == 0))
        cut = below.groupBy("parent").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
        up = cut.select("conv_id", F.explode(F.sequence(F.col("depth") - 2**j, F.col("depth") - 1)).alias("pos"), *totals)
        more = up.join(members, ["conv_id", "pos"]).groupBy("node").agg(*sums)
        added = more.select("node", *[F.col(c).alias(f"more_{c}") for c in totals])
        held = written(held.join(added, "node", "left").select("node", "depth", "parent", "conv_id", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in totals]))
    return held.select("node", *totals)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the textless root at depth 0 included.

    conversations: conv_id, turn, role, text. Result: conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Every conversation with a row is a
    member of the root, those without turns left too; rows whose conv_id is
    null take no part; without any conversation there is no node. Other
    columns are left out. See ``turns`` for ties and nulls.
    """
    seqs, depths = rebuilt(written(turns(conversations)))
    seqs, depths = written(seqs), written(depths)
    deepest = depths.agg(F.max("depth")).first()[0]
    levels = max(0, int(deepest or 0) - 1).bit_length()
    members = written(named(seqs, levels))
    nodes = members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("pos").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"))
    root = F.lit(b"root")
    above = members.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("node").alias("above"))
    nodes = written(nodes.join(above, ["conv_id", "depth"], "left").select("*", F.coalesce("above", root).alias("parent")).drop("above"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")))
    totals = ["n_leaves", "saved_tokens"]
    below = grafted(nodes, members, levels, totals)
    ends = members.join(depths.withColumnRenamed("depth", "pos"), ["conv_id", "pos"]).select("node", "conv_id").unionByName(depths.filter("depth = 0").select(root.alias("node"), "conv_id"))
    hashes = hashed_lists(ends)
    inner = nodes.drop(*totals, "words").join(below, "node")
    tops = inner.filter("depth = 1").select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"), F.lit(1).cast("long").alias("n_children"), *totals)
    tops = tops.unionByName(depths.select("conv_id", F.lit(1).cast("long").alias("n_convs"), *[F.lit(0).cast("long").alias(c) for c in ("n_children", *totals)]))
    top = tops.agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", *totals)]).filter("n_convs > 0")
    top = top.select(root.alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(None).cast("binary").alias("parent"), "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens")
    every = inner.select(*top.columns).unionByName(top)
    parents = every.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(parents, "parent", "left").join(hashes, "node", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(empty)).alias("ends_sha256"))


TRIE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS own FROM t GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN (x & 1) = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) % 4 AS h FROM o),
r AS (SELECT h.conv_id AS c, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS q FROM h LEFT JOIN o b ON b.conv_id = h.base),
m AS (SELECT c, d, q[1:d] AS p, len(q) AS l FROM (SELECT c, q, unnest(range(len(q) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE l = d)), sha256('')) AS ends_sha256 FROM m GROUP BY p, d),
k AS (SELECT *, CASE WHEN d > 0 THEN p[1:d - 1] END AS up, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n),
c AS (SELECT up AS p, count(*) AS n_children FROM k WHERE d > 0 GROUP BY up),
w AS (SELECT k.*, coalesce(c.n_children, 0) AS n_children FROM k LEFT JOIN c USING (p)),
s AS (SELECT a AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT p[1:i] AS a, n_children, saved FROM (SELECT p, n_children, saved, unnest(range(d + 1)) AS i FROM w)) GROUP BY a)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (p) LEFT JOIN w u ON u.p = w.up
"""
