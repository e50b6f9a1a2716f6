"""Registered queries of the catalog engine and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import names as N
from .functions import paths as P
from .functions.text import snippet, squeeze
from .operators import hygiene as H
from .operators import inventory as I
from .operators import meta as M
from .operators import search as S
from .operators import usage as U
from .plans import clean_up as C
from .sources import tables as T
from .streaming import monitors as R

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return T.documents_catalog(T.read(spark, d, "documents"))


def _lines(spark, d):
    return T.lineitem_catalog(T.read(spark, d, "lineitem"))


def _anc(c: str) -> str:
    """SQL: all proper ancestors of a path."""
    return f"list_transform(range(len(string_split({c}, '/'))), lambda i: array_to_string(string_split({c}, '/')[1:i], '/'))"


_PAR = "regexp_replace(relpath, '(^|/)[^/]*$', '')"
_NAME = "string_split(relpath, '/')[-1]"
_EXT = "lower(regexp_extract(string_split(relpath, '/')[-1], '(?s)^\\.*[^.].*?(\\.[^.]*)$', 1))"
W = "WITH " + T.ENTRIES_SQL
_CAT = f"""CASE WHEN starts_with({_NAME}, '~$') THEN 'office-lock' WHEN {_EXT} = '.vmdk' THEN 'vm-image' WHEN {_EXT} = '.iso' OR ({_EXT} = '.exe' AND {_NAME} LIKE '%setup%') THEN 'installer'
 WHEN {_EXT} = '.bak' THEN 'temp' WHEN {_NAME} LIKE '% (1).txt' OR {_NAME} LIKE '% - copy.txt' THEN 'conflict' WHEN size = 0 THEN 'empty-file' END"""
_FOUND = f"""fo AS (SELECT e.root, x.category, x.dir AS relpath, true AS is_dir, count(*) AS files, sum(size)::BIGINT AS size, false AS needs_review FROM entries e JOIN (SELECT DISTINCT root, {_PAR} AS dir, CASE WHEN relpath LIKE '%/node_modules/%' THEN 'regenerable' ELSE 'app-data' END AS category FROM entries WHERE relpath LIKE '%/node_modules/%' OR relpath LIKE '%/cache/%') x ON e.root = x.root AND starts_with(e.relpath, x.dir || '/') GROUP BY ALL),
 fi AS (SELECT a.root, a.cat AS category, a.relpath, false AS is_dir, 1::BIGINT AS files, a.size, a.cat = 'conflict' AND NOT coalesce(a.sha256 = o.sha256 AND a.cur AND o.cur, false) AS needs_review
  FROM (SELECT *, {_CAT} AS cat FROM entries) a LEFT JOIN entries o ON a.cat = 'conflict' AND o.root = a.root AND o.relpath = replace(replace(a.relpath, ' (1).txt', '.txt'), ' - copy.txt', '.txt') WHERE a.cat IS NOT NULL AND (a.cat <> 'conflict' OR o.relpath IS NOT NULL) AND NOT (a.relpath LIKE '%/node_modules/%' OR a.relpath LIKE '%/cache/%')),
 found AS (SELECT * FROM fo UNION ALL SELECT * FROM fi)"""


@query(f"{W}, {_FOUND} SELECT category, count(*) AS findings, sum(files)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM found GROUP BY category")
def hygiene_by_category(spark, d):
    return H.by_category(H.findings(_docs(spark, d)))


@query(f"{W}, {_FOUND} SELECT root, category, relpath, is_dir, files, size, needs_review FROM found")
def hygiene_findings(spark, d):
    return H.findings(_docs(spark, d))


@query(f"{W} SELECT root, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (cur) AS hashed_files, (sum(size) FILTER (cur))::BIGINT AS hashed_bytes FROM entries GROUP BY root")
def root_summary(spark, d):
    return H.root_summary(_docs(spark, d))


@query(f"WITH {T.LINES_SQL} SELECT root, dir, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT root, size, unnest({_anc('relpath')}) AS dir FROM entries) GROUP BY root, dir")
def subtree_sizes(spark, d):
    return H.subtree_sizes(_lines(spark, d))


@query(f"WITH {T.LINES_SQL} SELECT root, {_PAR} AS dir, count(*) AS files FROM entries GROUP BY ALL ORDER BY files DESC, root, dir LIMIT 15")
def fan_out_top(spark, d):
    return H.fan_out(_lines(spark, d))


@query(f"{W}, g AS (SELECT root, sha256, size, count(*) AS copies, min(relpath) AS first_path FROM entries WHERE size > 0 AND cur GROUP BY ALL) SELECT *, size * (copies - 1) AS waste FROM g WHERE copies > 1")
def duplicates(spark, d):
    return H.duplicates(_docs(spark, d))


@query(f"{W} SELECT root, relpath, size, mtime_ns FROM entries WHERE size >= 5000 AND mtime_ns < 50000000000000")
def stale_large(spark, d):
    return H.stale_large(_docs(spark, d), 5000, 50_000_000_000_000)


@query(f"{W}, n AS (SELECT root, {_PAR} AS dir, regexp_extract({_NAME}, '^(\\d{{1,3}})[_ .\\-)]', 1) AS t FROM entries), k AS (SELECT *, t::INT AS n FROM n WHERE t <> '') SELECT root, dir, count(*) AS files, count(*) - count(DISTINCT n) AS doubled, (max(n) - min(n) + 1 - count(DISTINCT n))::BIGINT AS missing, count(DISTINCT len(t)) AS widths FROM k GROUP BY root, dir HAVING count(*) >= 2")
def structure_numbering(spark, d):
    return H.numbering(_docs(spark, d))


@query(f"{W}, n AS (SELECT root, {_PAR} AS dir, CASE WHEN {_NAME} LIKE '2024-01-%' AND regexp_matches({_NAME}, '^2024-01-\\d{{2}}') THEN 'YYYY-MM-DD' WHEN {_NAME} LIKE '2024-01-%' THEN 'YYYY-MM' WHEN {_NAME} LIKE '2023_02%' THEN 'YYYY_MM' WHEN regexp_matches({_NAME}, '^(19|20)\\d{{6}}(\\D|$)') THEN 'YYYYMMDD' WHEN regexp_matches({_NAME}, '^(19|20)\\d{{4}}(\\D|$)') THEN 'YYYYMM' WHEN regexp_matches({_NAME}, '^(19|20)\\d{{2}}(\\D|$)') THEN 'YYYY' END AS f FROM entries) SELECT root, dir, count(*) AS files, string_agg(DISTINCT f, ',' ORDER BY f) AS formats FROM n WHERE f IS NOT NULL GROUP BY root, dir HAVING count(DISTINCT f) > 1")
def structure_mixed_dates(spark, d):
    return H.mixed_dates(_docs(spark, d))


@query(f"{W}, k AS (SELECT root, {_PAR} AS dir, CASE WHEN {_EXT} IN ('.txt', '.docx', '.pdf') THEN 'document' WHEN {_EXT} = '.jpg' THEN 'image' WHEN {_EXT} = '.mp3' THEN 'audio' WHEN {_EXT} = '.zip' THEN 'archive' END AS kind FROM entries), p AS (SELECT root, dir, kind, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY root, dir)::BIGINT AS files FROM p) SELECT root, dir, max(files) AS files, string_agg(kind, ',' ORDER BY kind) AS kinds FROM t WHERE files >= 10 AND kind IS NOT NULL AND n >= 0.02 * files GROUP BY root, dir HAVING count(*) >= 3")
def structure_mixed_kinds(spark, d):
    return H.mixed_kinds(_docs(spark, d), 10, 0.02)


_COPIES = """f AS (SELECT root, relpath, size, sha256, cur FROM entries UNION ALL SELECT root, 'mirror/' || relpath, size, sha256, cur FROM entries WHERE starts_with(relpath, 'src3/') OR starts_with(relpath, 'src4/en/')
 UNION ALL SELECT root, 'Backups 1/' || relpath, size, sha256, cur FROM entries WHERE starts_with(relpath, 'src5/') UNION ALL SELECT root, 'backup_1/' || relpath, size, sha256, cur FROM entries WHERE starts_with(relpath, 'src6/'))"""


def _copies(spark, d):
    """Some folders of the tree a second time, below folders with similar names; their hashes are all current."""
    e = _docs(spark, d)
    p = F.col("relpath")
    put = lambda name, rows: rows.withColumn("relpath", F.concat(F.lit(name), p))
    return e.unionByName(put("mirror/", e.filter(p.startswith("src3/") | p.startswith("src4/en/")))).unionByName(put("Backups 1/", e.filter(p.startswith("src5/")))).unionByName(put("backup_1/", e.filter(p.startswith("src6/"))))


@query(f"""{W}, {_COPIES}, fd AS (SELECT root, unnest({_anc('relpath')}) AS path, size FROM f), b AS (SELECT root, path, sum(size)::BIGINT AS size FROM fd WHERE path <> '' GROUP BY ALL)
SELECT root, '' AS dir, 'backup' AS skeleton, '1' AS digits, count(*) AS folders, min(path) AS first_name, sum(size)::BIGINT AS size FROM b WHERE path IN ('Backups 1', 'backup_1') GROUP BY ALL HAVING count(*) = 2""")
def structure_similar_siblings(spark, d):
    return H.similar_siblings(_copies(spark, d))


@query(f"""{W}, {_COPIES}, g AS (SELECT root, relpath, size, CASE WHEN cur THEN sha256 END AS h FROM f), u AS (SELECT *, unnest({_anc('relpath')}) AS dir FROM g),
 s AS (SELECT root, dir, count(*) AS files, sum(size)::BIGINT AS bytes, list_sort(list(substr(relpath, length(dir) + 2) || ':' || h)) AS sig FROM u WHERE dir <> '' GROUP BY ALL HAVING count(*) >= 2 AND count(*) = count(h)),
 a AS (SELECT x.* FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.root = x.root AND y.sig = x.sig AND (starts_with(y.dir, x.dir || '/') OR starts_with(x.dir, y.dir || '/')))),
 m AS (SELECT root, sig, list_sort(list(dir)) AS ds, any_value(files) AS files, arg_min(bytes, dir) AS bytes FROM a GROUP BY ALL HAVING count(*) >= 2), i AS (SELECT DISTINCT root, unnest(ds) AS dir FROM m),
 mm AS (SELECT root, sig, regexp_replace(unnest(ds), '(^|/)[^/]*$', '') AS dir FROM m), kn AS (SELECT mm.root, mm.sig, count(*) AS known FROM mm JOIN i ON i.root = mm.root AND i.dir = mm.dir GROUP BY ALL),
 k AS (SELECT m.*, coalesce(kn.known, 0) AS known FROM m LEFT JOIN kn ON kn.root = m.root AND kn.sig = m.sig),
 c AS (SELECT *, list_min(list_transform(ds, lambda d: len(string_split(d, '/')))) - 1 AS most FROM k WHERE known < len(ds)),
 n AS (SELECT *, len(list_filter(range(1, most + 1), lambda j: len(list_distinct(list_transform(ds, lambda d: array_to_string(string_split(d, '/')[-j:], '/')))) = 1)) AS common FROM c),
 o AS (SELECT *, list_sort(list_transform(ds, lambda d: array_to_string(string_split(d, '/')[1:len(string_split(d, '/')) - common], '/'))) AS org FROM n),
 r AS (SELECT *, row_number() OVER (PARTITION BY root, org ORDER BY files DESC, ds) AS rk, count(*) OVER (PARTITION BY root, org) - 1 AS more FROM o)
SELECT root, ds[1] AS path, files, len(ds) AS folders, more, bytes * (len(ds) - 1) AS size FROM r WHERE rk = 1""")
def structure_identical_folders(spark, d):
    e = _copies(spark, d)
    return H.identical_folders(e)


@query(f"{W}, b AS (SELECT root, relpath, ({_EXT} = '')::INT AS bare FROM entries), x AS (SELECT root, dir, count(*) AS files, sum(bare)::BIGINT AS bare FROM (SELECT root, bare, unnest({_anc('relpath')}) AS dir FROM b) WHERE dir <> '' GROUP BY ALL) SELECT root, dir, files, bare FROM x WHERE bare >= 1 AND bare * 2 >= files AND NOT EXISTS (SELECT 1 FROM x y WHERE y.root = x.root AND y.bare >= 1 AND y.bare * 2 >= y.files AND starts_with(y.dir, x.dir || '/'))")
def no_extension_folders(spark, d):
    return H.no_extension_folders(_docs(spark, d), 1)


@query(f"{W} SELECT root, relpath, size FROM entries WHERE contains(lower(relpath), 'src1') AND contains(lower(relpath), '7') AND {_EXT} IN ('.txt', '.pdf', '.docx') AND size BETWEEN 500 AND 5000 AND mtime_ns >= 20000000000000")
def search_combined(spark, d):
    found = S.find(_docs(spark, d), words="SRC1 7", kind="document", min_size=500, max_size=5000, after_ns=20_000_000_000_000)
    return found.select("root", "relpath", "size")


@query(f"{W} SELECT root, relpath, mtime_ns FROM entries WHERE starts_with(relpath, 'src3/en/') ORDER BY mtime_ns DESC, relpath LIMIT 20")
def search_under_newest(spark, d):
    return S.find(_docs(spark, d), under="src3/en").orderBy(F.desc("mtime_ns"), "relpath").limit(20).select("root", "relpath", "mtime_ns")


@query(f"{W} SELECT root, sha256, min(relpath) AS relpath, count(*) AS copies FROM entries WHERE starts_with(relpath, 'src') AND sha256 IS NOT NULL GROUP BY root, sha256")
def search_collapsed(spark, d):
    return S.collapse(S.find(_docs(spark, d), words="src")).select("root", "sha256", "relpath", "copies")


def _extracts(spark, d):
    return T.read(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "text")


_TEXT = "WITH x AS (SELECT DISTINCT sha256(text) AS sha256, text FROM documents)"


@query(f"{_TEXT} SELECT sha256 FROM x WHERE contains(lower(text), 'license') AND contains(lower(text), 'the')")
def search_text_scan(spark, d):
    return S.text_matches(_extracts(spark, d), ["license", "the"]).select("sha256").distinct()


@query(f"{_TEXT} SELECT sha256 FROM x WHERE contains(lower(text), 'license') AND contains(lower(text), 'the')")
def search_text_indexed(spark, d):
    x = _extracts(spark, d)
    return S.indexed_matches(S.trigram_index(x), x, ["license", "the"]).select("sha256").distinct()


@query("SELECT doc_id, CASE WHEN greatest(strpos(lower(text), 'license') - 40, 1) > 1 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, greatest(strpos(lower(text), 'license') - 40, 1), 120), '\\s+', ' ', 'g')) || CASE WHEN greatest(strpos(lower(text), 'license') - 40, 1) + 119 < length(text) THEN '…' ELSE '' END AS snippet FROM documents WHERE contains(lower(text), 'license')")
def search_snippets(spark, d):
    t = T.read(spark, d, "documents")
    return t.filter(F.lower("text").contains("license")).select("doc_id", snippet(F.col("text"), "license").alias("snippet"))


@query(f"{W}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY mtime_ns DESC, root, relpath) AS rn FROM entries WHERE cur AND {_EXT} IN ('.txt', '.pdf', '.docx') AND sha256 NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)) SELECT sha256, root, relpath, mtime_ns, CASE WHEN {_EXT} = '.txt' THEN 1 ELSE 0 END AS priority FROM r WHERE rn = 1")
def extraction_pending(spark, d):
    done = T.read(spark, d, "documents").filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256")).distinct()
    return S.pending(_docs(spark, d), done, N.KINDS["document"])


_CHG = f"""{W}, {T.OBS_SQL}, ch AS (SELECT coalesce(a.root, b.root) AS root, coalesce(a.relpath, b.relpath) AS relpath, a.inode AS o_inode, b.inode, a.size AS o_size, b.size, CASE WHEN b.relpath IS NULL THEN 'missing' WHEN a.relpath IS NULL THEN 'new' WHEN a.size = b.size AND a.mtime_ns = b.mtime_ns AND a.inode = b.inode THEN 'same' ELSE 'changed' END AS state FROM entries a FULL JOIN obs b ON a.root = b.root AND a.relpath = b.relpath),
 mv AS (SELECT g.root, g.relpath AS old_relpath, min(n.relpath) AS new_relpath FROM (SELECT * FROM ch WHERE state = 'missing' QUALIFY count(*) OVER (PARTITION BY root, o_inode) = 1) g JOIN ch n ON n.state = 'new' AND n.root = g.root AND n.inode = g.o_inode GROUP BY ALL)"""


def _changes(spark, d):
    e = _docs(spark, d)
    return I.diff(e, T.second_observation(e))


@query(f"{_CHG} SELECT root, relpath, state, o_size, size FROM ch")
def inventory_diff(spark, d):
    return _changes(spark, d).select("root", "relpath", "state", "o_size", "size")


@query(f"{_CHG} SELECT root, old_relpath, new_relpath, false AS is_dir FROM mv")
def inventory_moves(spark, d):
    return I.inode_moves(_changes(spark, d))


@query(f"{_CHG}, c AS (SELECT root, count(*) FILTER (state <> 'missing') AS seen, count(*) FILTER (state = 'new') AS n, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'missing') AS g FROM ch GROUP BY root) SELECT c.root, seen, n - (SELECT count(*) FROM mv) AS added, changed, (SELECT count(*) FROM mv) AS moved, g - (SELECT count(*) FROM mv) AS gone FROM c")
def inventory_counters(spark, d):
    c = _changes(spark, d)
    return I.scan_counters(c, I.inode_moves(c))


@query(f"{_CHG} SELECT root, count(*) FILTER (state <> 'new') AS live, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'missing') > greatest(100, floor(count(*) FILTER (state <> 'new') * 0.2)) AS hold FROM ch WHERE state <> 'new' GROUP BY root")
def inventory_safety_valve(spark, d):
    return I.safety_valve(_changes(spark, d))


@query("""WITH e AS (SELECT doc_id, 'h' || (doc_id % 97) AS sha256, 9 AS size, doc_id % 5 AS t, CASE WHEN doc_id % 3 = 0 THEN 'p' || (doc_id // 6) ELSE 'n' || (doc_id % 41) END AS name FROM documents),
 o AS (SELECT sha256, CASE WHEN doc_id % 10 = 1 THEN 'same/' || doc_id ELSE 'old/' || doc_id || '/' || name END AS p, CASE WHEN doc_id % 10 = 1 THEN doc_id::VARCHAR ELSE name END AS name, t AS seen FROM e WHERE doc_id % 2 = 1),
 n AS (SELECT sha256, CASE WHEN doc_id % 10 = 2 THEN 'same/' || (doc_id - 1) ELSE 'new/' || doc_id || '/' || name END AS p, CASE WHEN doc_id % 10 = 2 THEN (doc_id - 1)::VARCHAR ELSE name END AS name, t + 1 AS seen FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN 'h' || ((doc_id - 1) % 97) ELSE sha256 END AS sha256, t, name FROM e) WHERE doc_id % 2 = 0),
 a AS (SELECT o.sha256, o.p AS op, n.p AS np FROM o JOIN n ON o.sha256 = n.sha256 AND o.p = n.p AND o.seen < n.seen),
 o1 AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.sha256 = o.sha256 AND a.op = o.p)), n1 AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.sha256 = n.sha256 AND a.np = n.p)),
 c AS (SELECT sha256, (SELECT count(*) FROM n1 x WHERE x.sha256 = k.sha256) AS cn, (SELECT count(*) FROM o1 x WHERE x.sha256 = k.sha256) AS co FROM (SELECT DISTINCT sha256 FROM e) k),
 b AS (SELECT o1.sha256, o1.p AS op, n1.p AS np FROM o1 JOIN n1 USING (sha256) JOIN c USING (sha256) WHERE cn = 1 AND co = 1 AND o1.seen < n1.seen),
 m AS (SELECT n1.sha256, n1.p AS np, min(o1.p) AS op, count(*) AS k FROM n1 JOIN o1 ON o1.sha256 = n1.sha256 AND o1.name = n1.name AND o1.seen < n1.seen JOIN c ON c.sha256 = n1.sha256 WHERE NOT (cn = 1 AND co = 1) AND (SELECT count(*) FROM n1 y WHERE y.sha256 = n1.sha256 AND y.name = n1.name) = 1 GROUP BY ALL)
SELECT 'docs' AS root, op AS old_relpath, np AS new_relpath, 'path' AS rule FROM a UNION ALL SELECT 'docs', op, np, 'content' FROM b UNION ALL SELECT 'docs', op, np, 'name' FROM m WHERE k = 1""")
def inventory_relink(spark, d):
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    name = F.when(i % 3 == 0, F.concat(F.lit("p"), s(F.floor(i / 6)))).otherwise(F.concat(F.lit("n"), s(i % 41)))
    rows = T.read(spark, d, "documents").select("doc_id", F.lit("docs").alias("root"), F.lit(9).cast("long").alias("size"), (i % 5).alias("t"), name.alias("name"))
    path = lambda kind, same, number: F.when(same, F.concat(F.lit("same/"), s(number))).otherwise(F.concat(F.lit(f"{kind}/"), s(i), F.lit("/"), "name"))
    back = i % 10 == 2
    old = rows.filter(i % 2 == 1).select("root", path("old", i % 10 == 1, i).alias("relpath"), F.concat(F.lit("h"), s(i % 97)).alias("sha256"), "size", F.col("t").alias("last_seen"))
    new = rows.filter(i % 2 == 0).select("root", path("new", back, i - 1).alias("relpath"), F.concat(F.lit("h"), s(F.when(back, i - 1).otherwise(i) % 97)).alias("sha256"), "size", (F.col("t") + 1).alias("first_seen"))
    return I.relink(old, new)


def _shots(spark, d):
    e = _docs(spark, d)
    one = e.select("root", F.lit(1).alias("taken_at"), "relpath", "size", "mtime_ns")
    return one.union(T.second_observation(e).select("root", F.lit(2), "relpath", "size", "mtime_ns"))


@query(f"{W}, {T.OBS_SQL}, j AS (SELECT a.relpath AS a, b.relpath AS b, a.size AS az, a.size <> b.size OR a.mtime_ns <> b.mtime_ns AS diff FROM entries a FULL JOIN obs b ON a.relpath = b.relpath), c AS (SELECT count(a) AS before, count(b) AS after, count(*) FILTER (b IS NULL) AS deleted, count(*) FILTER (diff) AS changed, count(*) FILTER (a IS NULL) AS added, coalesce(sum(az) FILTER (b IS NULL), 0)::BIGINT AS bytes_lost FROM j) SELECT 'docs' AS root, 2 AS newer, *, (deleted > 200 AND deleted > before * 0.1) OR (changed > 300 AND changed > before * 0.3) AS alert FROM c")
def snapshot_diff(spark, d):
    return I.snapshot_diff(_shots(spark, d))


@query(f"{W}, {T.OBS_SQL} SELECT root, relpath, size, 1::BIGINT AS snapshots, 1 AS newest FROM entries e WHERE size >= 3000 AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.relpath = e.relpath AND o.size = e.size)")
def snapshot_only_large(spark, d):
    e = _docs(spark, d)
    return I.snapshot_only(_shots(spark, d).filter("taken_at = 1"), T.second_observation(e), 3000)


def _log(spark, d):
    return T.event_log(T.read(spark, d, "events"))


_TAGS = f"WITH {T.EVENTS_SQL}, tg AS (SELECT root, path, tag FROM (SELECT *, row_number() OVER (PARTITION BY root, path, tag ORDER BY seq DESC) AS r FROM ev) WHERE r = 1 AND op = 'add')"


def _tags(spark, d):
    log = _log(spark, d).withColumn("src", F.lit(None).cast("string")).withColumn("dst", F.lit(None).cast("string"))
    return M.fold_tags(log)


@query(f"{_TAGS} SELECT * FROM tg")
def tags_folded(spark, d):
    return _tags(spark, d)


@query(f"""WITH {T.EVENTS_SQL}, mv AS (SELECT event_id AS m, 'src' || (event_id % 20) AS src FROM events WHERE event_id % 97 = 0),
 f AS (SELECT ev.*, mv.m FROM (SELECT *, split_part(path, '/', 1) AS top FROM ev WHERE seq % 97 <> 0) ev ASOF LEFT JOIN mv ON ev.top = mv.src AND ev.seq < mv.m),
 l AS (SELECT *, row_number() OVER (PARTITION BY root, path, tag, m ORDER BY seq DESC) AS r FROM f)
SELECT DISTINCT root, CASE WHEN m IS NULL THEN path ELSE 'old/' || path END AS path, tag FROM l WHERE r = 1 AND op = 'add'""")
def tags_folded_with_moves(spark, d):
    log = _log(spark, d)
    move = F.col("seq") % 97 == 0
    n = (F.col("seq") % 20).cast("string")
    log = log.select("seq", "root", F.when(~move, F.col("path")).alias("path"), "tag", F.when(move, "move").otherwise(F.col("op")).alias("op"), F.when(move, F.concat(F.lit("src"), n)).alias("src"), F.when(move, F.concat(F.lit("old/src"), n)).alias("dst"))
    return M.fold_tags(log)


@query(f"{_TAGS} SELECT tag, count(*) AS items FROM tg GROUP BY tag")
def tag_counts(spark, d):
    return _tags(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("items"))


_EFF = f"{_TAGS}, {T.ENTRIES_SQL}, ef AS (SELECT DISTINCT e.root, e.relpath, t.tag FROM entries e JOIN tg t ON e.root = t.root AND (e.relpath = t.path OR starts_with(e.relpath, t.path || '/')))"


@query(f"{_EFF} SELECT tag, count(*) AS files FROM ef GROUP BY tag")
def effective_tag_counts(spark, d):
    return M.effective_tags(_docs(spark, d), _tags(spark, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("files"))


@query(f"{_EFF}, tp AS (SELECT DISTINCT tag, split_part(tag, ':', 1) AS up FROM ef) SELECT up AS tag, count(DISTINCT relpath) AS files FROM ef JOIN tp ON ef.tag = tp.tag GROUP BY up")
def implied_tag_counts(spark, d):
    tags = _tags(spark, d)
    closure = M.tag_closure(tags.select("tag", F.substring_index("tag", ":", 1).alias("parent")).distinct())
    eff = M.effective_tags(_docs(spark, d), tags, closure)
    return eff.filter(~F.col("tag").contains(":")).groupBy("tag").agg(F.count_distinct("relpath").alias("files"))


@query(f"{_EFF} SELECT root, relpath FROM entries e WHERE EXISTS (SELECT 1 FROM ef WHERE ef.relpath = e.relpath AND tag = 'click:1') AND EXISTS (SELECT 1 FROM ef WHERE ef.relpath = e.relpath AND tag = 'view:2') AND NOT EXISTS (SELECT 1 FROM ef WHERE ef.relpath = e.relpath AND tag = 'purchase:3')")
def tag_search(spark, d):
    e = _docs(spark, d)
    return M.tag_search(e, M.effective_tags(e, _tags(spark, d)), ["click:1", "view:2"], "and", ["purchase:3"])


_ATTR = "va AS (SELECT root, path, name, value FROM (SELECT 'docs' AS root, 'src' || (user_id % 20) || CASE WHEN user_id % 3 = 0 THEN '/en' ELSE '' END AS path, event_type AS name, event_id::VARCHAR AS value, row_number() OVER (PARTITION BY user_id % 20, user_id % 3 = 0, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)"


@query(f"{W}, {_ATTR}, h AS (SELECT e.root, e.relpath, v.name, v.value, v.path, row_number() OVER (PARTITION BY e.root, e.relpath, v.name ORDER BY len(v.path) DESC) AS r FROM entries e JOIN va v ON e.root = v.root AND (e.relpath = v.path OR starts_with(e.relpath, v.path || '/'))) SELECT root, relpath, name, value, path AS from_path FROM h WHERE r = 1")
def effective_attributes(spark, d):
    log = T.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("docs").alias("root"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.when(F.col("user_id") % 3 == 0, "/en").otherwise("")).alias("path"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), F.lit("attr-set").alias("op"))
    return M.effective_attributes(_docs(spark, d), M.last_values(log))


@query("SELECT DISTINCT 'lines' AS root, l_returnflag || '/' || l_linestatus AS dir, 'dated' AS type FROM lineitem UNION ALL SELECT DISTINCT 'lines', l_returnflag || '/' || l_linestatus || '/' || strftime(l_shipdate, '%Y'), 'numbered' FROM lineitem WHERE false")
def folder_types(spark, d):
    return M.inferred_folder_types(_lines(spark, d))


@query()
def similar_documents(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), squeeze(F.col("text")).alias("text"))
    return S.similar(docs, T.read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("WITH u AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'big' WHEN conv_id % 3 = 1 THEN 'small' ELSE 'local' END AS model, role AS purpose, length(text) AS i, (turn + 1) * 10 AS o FROM conversations) SELECT model, purpose, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(CASE model WHEN 'big' THEN (i * 5.0 + o * 25.0) / 1000000 WHEN 'small' THEN (i * 1.0 + o * 5.0) / 1000000 END), 6) AS cost, count(*) FILTER (model = 'local') AS unpriced FROM u GROUP BY ALL")
def usage_summary(spark, d):
    c = T.read(spark, d, "conversations")
    model = F.when(F.col("conv_id") % 3 == 0, "big").when(F.col("conv_id") % 3 == 1, "small").otherwise("local")
    rows = c.select(model.alias("model"), F.col("role").alias("purpose"), F.length("text").cast("long").alias("input_tokens"), ((F.col("turn") + 1) * 10).alias("output_tokens"), F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("cache_write_tokens"))
    return U.summary(rows, {"big": (5.0, 25.0), "small": (1.0, 5.0)})


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('seed' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM r ORDER BY r, n DESC, lang LIMIT 40")
def evaluation_sample(spark, d):
    return U.stratified(T.read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 40, "seed")


_LATER = "nw AS (SELECT root, relpath, CASE WHEN doc_id % 23 = 0 THEN size + 1 ELSE size END AS size, mtime_ns, inode FROM entries WHERE doc_id % 19 <> 0)"


@query(f"""{W}, {_FOUND}, {_LATER}, q AS (SELECT a.root, a.relpath, o.relpath AS requires, o.size AS requires_size, o.mtime_ns AS requires_mtime_ns FROM entries a JOIN entries o ON o.root = a.root AND o.relpath = replace(replace(a.relpath, ' (1).txt', '.txt'), ' - copy.txt', '.txt') AND o.relpath <> a.relpath),
 p AS (SELECT f.root, 'quarantine' AS action, f.relpath AS path, f.is_dir, count(*) AS files, sum(n.size)::BIGINT AS size, max(n.mtime_ns) AS mtime_ns, max(CASE WHEN n.relpath = f.relpath THEN n.inode END) AS inode, f.category FROM found f JOIN nw n ON n.root = f.root AND (n.relpath = f.relpath OR (f.is_dir AND starts_with(n.relpath, f.relpath || '/'))) GROUP BY ALL)
SELECT p.*, q.requires, q.requires_size, q.requires_mtime_ns FROM p LEFT JOIN q ON q.root = p.root AND q.relpath = p.path LEFT JOIN nw r ON r.root = q.root AND r.relpath = q.requires LEFT JOIN entries e ON e.root = p.root AND e.relpath = p.path
WHERE (p.is_dir OR (e.size = p.size AND e.mtime_ns = p.mtime_ns)) AND (q.requires IS NULL OR (r.size = q.requires_size AND r.mtime_ns = q.requires_mtime_ns))""")
def plan_build(spark, d):
    """Reviews included; a listing made later, in which files are gone or changed, decides what still holds."""
    e = _docs(spark, d)
    i = F.floor(F.col("entry_id") / 2)
    now = e.filter(i % 19 != 0).withColumn("size", F.when(i % 23 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return C.build(H.findings(e), e, reviews=True, requires=H.required(e), now=now)


@query(f"""{W}, {T.OBS_SQL}, fst AS (SELECT *, first_value(relpath) OVER w AS fp, first_value(size) OVER w AS fs, first_value(mtime_ns) OVER w AS fm FROM entries WINDOW w AS (PARTITION BY root, {_PAR} ORDER BY relpath)),
 ops AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'moved/' || relpath WHEN 1 THEN {_PAR} || '/' || upper(string_split(fp, '/')[-1]) WHEN 2 THEN 'NEW/' || relpath END AS dest, CASE WHEN doc_id % 4 = 1 THEN fp END AS requires, CASE WHEN doc_id % 8 = 1 THEN -1 ELSE fs END AS rsize, fm AS rtime FROM fst),
 dirs AS (SELECT root, {_anc('relpath')}[2] AS relpath, count(*) AS files, sum(size)::BIGINT AS size, max(mtime_ns) AS mtime_ns FROM entries GROUP BY ALL),
 od AS (SELECT root, {_anc('relpath')}[2] AS relpath, count(*) AS files, sum(size)::BIGINT AS size, max(mtime_ns) AS mtime_ns FROM obs GROUP BY ALL),
 un AS (SELECT root, unnest(list_append({_anc('relpath')}, relpath)) AS relpath FROM obs), kd AS (SELECT DISTINCT root, relpath, {_PAR} AS par, lower({_NAME}) AS key FROM un WHERE relpath <> ''),
 st AS (SELECT root, relpath AS path, dest, unnest(list_append({_anc('dest')}, dest)) AS step FROM ops WHERE dest IS NOT NULL), sk AS (SELECT *, regexp_replace(step, '(^|/)[^/]*$', '') AS par, lower(string_split(step, '/')[-1]) AS key FROM st WHERE step <> ''),
 cl AS (SELECT DISTINCT sk.root, path FROM sk JOIN kd ON kd.root = sk.root AND kd.par = sk.par AND kd.key = sk.key WHERE kd.relpath <> step AND kd.relpath <> path AND NOT starts_with(path, kd.relpath || '/')),
 ex AS (SELECT DISTINCT root, relpath FROM un)
SELECT p.root, p.relpath AS path, CASE WHEN o.relpath IS NULL THEN 'missing' WHEN o.inode <> p.inode THEN 'replaced' WHEN o.size <> p.size OR o.mtime_ns <> p.mtime_ns THEN 'changed'
 WHEN p.requires IS NOT NULL AND r.relpath IS NULL THEN 'prerequisite missing' WHEN p.requires IS NOT NULL AND p.rsize >= 0 AND (r.size <> p.rsize OR r.mtime_ns <> p.rtime) THEN 'prerequisite changed'
 WHEN x.relpath IS NOT NULL THEN 'destination exists' WHEN c.path IS NOT NULL THEN 'case clash' END AS problem
FROM ops p LEFT JOIN obs o ON o.root = p.root AND o.relpath = p.relpath LEFT JOIN obs r ON r.root = p.root AND r.relpath = p.requires LEFT JOIN ex x ON x.root = p.root AND x.relpath = p.dest LEFT JOIN cl c ON c.root = p.root AND c.path = p.relpath
UNION ALL SELECT d.root, d.relpath, CASE WHEN o.relpath IS NULL THEN 'missing' WHEN o.files <> d.files OR o.size <> d.size OR o.mtime_ns <> d.mtime_ns THEN 'changed' END FROM dirs d LEFT JOIN od o USING (root, relpath)""")
def plan_check(spark, d):
    """Moves, quarantines with prerequisites, and folders, against the listing of one scan later."""
    e = _docs(spark, d)
    i = F.floor(F.col("entry_id") / 2)
    p = F.col("relpath")
    firsts = e.groupBy("root", P.parent(p).alias("dir")).agg(F.min(F.struct("relpath", "size", "mtime_ns")).alias("f"))
    dest = F.when(i % 5 == 0, F.concat(F.lit("moved/"), p)).when(i % 5 == 1, F.concat("dir", F.lit("/"), F.upper(P.basename(F.col("f.relpath"))))).when(i % 5 == 2, F.concat(F.lit("NEW/"), p))
    wants = F.when(i % 4 == 1, F.col("f.relpath"))
    files = e.withColumn("dir", P.parent(p)).join(firsts, ["root", "dir"]).select("root", p.alias("path"), dest.alias("dest"), "inode", F.lit(1).cast("long").alias("files"), "size", "mtime_ns", "is_dir", wants.alias("requires"), F.when(i % 8 == 1, -1).otherwise(F.col("f.size")).cast("long").alias("requires_size"), F.col("f.mtime_ns").alias("requires_mtime_ns"))
    top = e.groupBy("root", F.element_at(P.ancestors(p), 2).alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.max("mtime_ns").alias("mtime_ns")).withColumn("is_dir", F.lit(True))
    return C.check(files.unionByName(top, allowMissingColumns=True), T.second_observation(e)).select("root", "path", "problem")


_JOURNAL = """WITH j AS (SELECT 'p' || (user_id % 997) AS plan_id, event_id AS seq, CASE WHEN event_id % 13 < 2 THEN 'apply' WHEN event_id % 13 < 5 THEN 'quarantine' WHEN event_id % 13 < 6 THEN 'move' WHEN event_id % 13 < 8 THEN 'finish' WHEN event_id % 13 < 9 THEN 'abort' WHEN event_id % 13 < 11 THEN 'restore' WHEN event_id % 13 = 11 THEN 'purge' ELSE 'other' END AS event, 'f' || (event_id % 3) AS path, floor(value)::BIGINT AS size FROM events)"""
_PENDING = """s AS (SELECT plan_id, path, max(seq) AS settled FROM j WHERE event IN ('restore', 'purge') GROUP BY ALL),
 pd AS (SELECT j.plan_id, j.path, arg_max(event, seq) AS event, arg_max(size, seq) AS size, min(seq) AS began FROM j LEFT JOIN s USING (plan_id, path) WHERE event IN ('quarantine', 'move') AND (settled IS NULL OR seq > settled) GROUP BY ALL)"""


def _journal(spark, d):
    e = T.read(spark, d, "events")
    m = F.col("event_id") % 13
    event = F.when(m < 2, "apply").when(m < 5, "quarantine").when(m < 6, "move").when(m < 8, "finish").when(m < 9, "abort").when(m < 11, "restore").when(m == 11, "purge").otherwise("other")
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 997).cast("string")).alias("plan_id"), F.col("event_id").alias("seq"), event.alias("event"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("path"), F.floor("value").cast("long").alias("size"))


@query(f"""{_JOURNAL}, {_PENDING}, a AS (SELECT plan_id, max(seq) AS run FROM j WHERE event = 'apply' GROUP BY ALL),
 f AS (SELECT j.plan_id, a.run, bool_or(event = 'restore') AS restored, bool_or(event = 'purge') AS purged, coalesce(bool_or(event = 'finish' AND seq > run), false) AS finished, min(CASE WHEN event = 'abort' AND seq > run THEN seq END) AS aborted, min(CASE WHEN event IN ('quarantine', 'move') AND seq > run THEN seq END) AS acted FROM j LEFT JOIN a USING (plan_id) GROUP BY ALL),
 n AS (SELECT plan_id, count(*) AS pending, sum(size)::BIGINT AS pending_size FROM pd GROUP BY ALL)
SELECT plan_id, CASE WHEN run IS NULL OR (aborted IS NOT NULL AND (acted IS NULL OR aborted < acted)) THEN 'draft' WHEN NOT finished THEN 'interrupted' WHEN purged AND pending IS NULL THEN 'purged' WHEN restored AND pending IS NOT NULL THEN 'partially-undone' WHEN restored THEN 'undone' ELSE 'applied' END AS state, coalesce(pending, 0) AS pending, coalesce(pending_size, 0) AS pending_size FROM f LEFT JOIN n USING (plan_id)""")
def journal_state(spark, d):
    return C.journal_state(_journal(spark, d))


@query(f"{_JOURNAL}, {_PENDING} SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY began DESC) AS undo FROM pd")
def pending_restores(spark, d):
    return C.pending_restores(_journal(spark, d))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    return R.hourly(T.read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH l AS (SELECT 'e' || (user_id % 9) AS entry, event_id AS n, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'copied' WHEN 'click' THEN 'deleted' WHEN 'purchase' THEN 'heading' END AS kind FROM events),
 s AS (SELECT entry, max(n) FILTER (kind = 'heading') AS s, count(*) FILTER (kind = 'heading') AS runs FROM l GROUP BY entry)
SELECT l.entry, max(runs) AS runs, count(*) FILTER (kind = 'copied') AS copied, count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'error') AS errors, 'f' || max(n) FILTER (kind IN ('copied', 'deleted')) AS last_file FROM l JOIN s ON l.entry = s.entry WHERE s IS NULL OR n >= s GROUP BY l.entry""")
def sync_progress(spark, d):
    e = T.read(spark, d, "events")
    t, f = F.col("event_type"), F.concat(F.lit("f"), F.col("event_id").cast("string"))
    line = F.when(t == "error", "ERROR : failed").when(t == "view", F.concat(f, F.lit(": Copied (new)"))).when(t == "click", F.concat(f, F.lit(": Deleted"))).when(t == "purchase", "run started").otherwise("idle")
    return R.progress(e.select(F.concat(F.lit("e"), (F.col("user_id") % 9).cast("string")).alias("entry"), F.col("event_id").alias("line_no"), line.alias("line")))


@query(f"{W} SELECT relpath, CASE WHEN {_NAME} LIKE '~$%' THEN 'lock prefix' END AS problem FROM entries")
def cloud_name_problems(spark, d):
    return _docs(spark, d).select("relpath", N.cloud_name_problem(F.col("relpath")).alias("problem"))


@query(f"{W} SELECT relpath, {_PAR} AS parent, {_NAME} AS name, {_EXT} AS ext, len(string_split(relpath, '/'))::INT AS depth FROM entries")
def path_functions(spark, d):
    p = F.col("relpath")
    return _docs(spark, d).select("relpath", P.parent(p).alias("parent"), P.basename(p).alias("name"), P.extension(p).alias("ext"), P.depth(p).alias("depth"))


@query("SELECT l.doc_id, d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) ORDER BY l.doc_id DESC LIMIT 200")
def review_queue(spark, d):
    lab, docs = T.read(spark, d, "labels"), T.read(spark, d, "documents")
    decided = lab.filter("quality = 0").select("doc_id")
    return lab.join(docs.select("doc_id", "lang"), "doc_id").join(decided, "doc_id", "left_anti").orderBy(F.desc("doc_id")).limit(200).select("doc_id", "lang", "quality", "toxic")
