"""Registered queries over listings, history, decisions and names, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import names as N
from .functions import paths as P
from .functions.text import highlight, nfkc_casefold
from .operators import browse as B
from .operators import attach as A
from .operators import decide as D
from .operators import dictionary as K
from .operators import fold as G
from .operators import history as H
from .operators import hygiene as Y
from .operators import meta as M
from .operators import postings as I
from .operators import saved as V
from .operators import search as S
from .queries import _ATTR, _EFF, _EXT, _FOUND, _NAME, _PAR, _anc, _docs, _lines, _log, _shots, _tags, _TAGS, W, query
from .sources import shared
from .sources import tables as T
from .streaming import live as R


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS seen FROM supplier WHERE s_acctbal > 8000 GROUP BY ALL)
SELECT n_name AS root, coalesce(seen, 0) AS seen, coalesce(seen, 0) > 0 AS accepted FROM nation LEFT JOIN s ON n_nationkey = k""")
def roots_guarded(spark, d):
    nation = T.read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("root"))
    seen = T.read(spark, d, "supplier").filter("s_acctbal > 8000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("root")
    return B.guarded_roots(nation, seen)


def _exclusions(spark):
    types = spark.createDataFrame([("docs", "src3/en", "exclude"), ("docs", "src1", "inbox")], "root string, path string, type string")
    replicas = spark.createDataFrame([("docs", "/src5/", "other/place")], "root string, relpath string, original string")
    roots = spark.createDataFrame([("docs", "/data"), ("inner", "/data/src7"), ("far", "/database")], "root string, path string")
    return B.scan_exclusions(types, replicas, roots)


@query(f"""{W}, x AS (SELECT * FROM (VALUES ('src3/en', 'type'), ('src5', 'replica of other/place'), ('src7', 'root inner')) t(p, reason))
SELECT coalesce(reason, '') AS reason, count(*) AS files FROM entries LEFT JOIN x ON starts_with(relpath, p || '/') GROUP BY ALL""")
def scan_exclusion_counts(spark, d):
    e = _docs(spark, d)
    x = _exclusions(spark)
    up = e.select("root", F.col("relpath").alias("at"), F.explode(P.self_and_ancestors(F.col("relpath"))).alias("relpath")).join(x, ["root", "relpath"])
    return Y.outside(e.select("root", "relpath"), x).select(F.lit("").alias("reason")).union(up.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query(f"{W} SELECT root, relpath, size FROM entries WHERE NOT cur")
def hash_pending(spark, d):
    return B.hash_pending(_docs(spark, d))


_GONE = "g AS (SELECT root, relpath, size, NULL::BIGINT AS gone_at FROM entries WHERE doc_id % 7 <> 0 UNION ALL SELECT root, relpath, size + k * 100, 1000 + k * doc_id FROM entries, (SELECT unnest([1, 2]) AS k) WHERE doc_id % 5 = 0 OR doc_id % 7 = 0)"


@query(f"{W}, {_GONE} SELECT root, relpath, size, gone_at FROM (SELECT *, row_number() OVER (PARTITION BY root, relpath ORDER BY gone_at IS NULL DESC, gone_at DESC) AS r FROM g WHERE size <= 3000 AND contains(lower(relpath), 'src1')) WHERE r = 1")
def search_with_gone(spark, d):
    e = _docs(spark, d).withColumn("i", F.floor(F.col("entry_id") / 2))
    live = e.filter("i % 7 <> 0").withColumn("gone_at", F.lit(None).cast("long"))
    gone = e.filter("i % 5 = 0 OR i % 7 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("size", F.col("size") + F.col("k") * 100).withColumn("gone_at", (1000 + F.col("k") * F.col("i")).cast("long")).drop("k")
    found = S.find(live.unionByName(gone), words="SRC1", max_size=3000)
    return B.newest_state(found).select("root", "relpath", "size", "gone_at")


@query(f"{W}, k AS (SELECT DISTINCT root, unnest({_anc('relpath')}) AS relpath FROM entries) SELECT root, relpath FROM (SELECT * FROM k WHERE contains(relpath, 'e') ORDER BY length(relpath), relpath LIMIT 50)")
def folder_picker(spark, d):
    folders = _docs(spark, d).select("root", F.explode(P.ancestors(F.col("relpath"))).alias("relpath")).distinct()
    return B.folder_picker(folders, "e")


@query(f"{W}, b AS (SELECT root, substr(relpath, 6) AS rest, size FROM entries WHERE starts_with(relpath, 'src1/')) SELECT root, split_part(rest, '/', 1) AS name, contains(rest, '/') AS is_dir, count(*) AS files, sum(size)::BIGINT AS size FROM b GROUP BY ALL")
def folder_children(spark, d):
    return B.children(_docs(spark, d), "src1")


@query(f"""{_TAGS}, {T.ENTRIES_SQL}, s AS (SELECT root, sha256, list_sort(list(relpath)) AS paths FROM entries GROUP BY ALL), x AS (SELECT DISTINCT sha256(text) AS sha256, length(text) AS chars FROM documents)
SELECT e.root, e.relpath, e.size, coalesce(array_to_string(list_filter(s.paths[1:21], lambda p: p <> e.relpath)[1:20], '|'), '') AS same, x.chars, '' AS tags FROM entries e JOIN s USING (root, sha256) LEFT JOIN x USING (sha256)""")
def item_details(spark, d):
    x = T.read(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "text").dropDuplicates(["sha256"])
    return B.details(_docs(spark, d), x, _tags(spark, d)).withColumn("chars", F.col("chars").cast("long"))


@query("SELECT doc_id, substring(text, 101, 50) AS part, length(text) > 150 AS truncated FROM documents")
def text_slices(spark, d):
    return B.text_slice(T.read(spark, d, "documents"), 100, 50).select("doc_id", "part", "truncated")


@query(f"{_TAGS}, {T.ENTRIES_SQL} SELECT root, path, EXISTS (SELECT 1 FROM entries e WHERE e.root = tg.root AND (e.relpath = tg.path OR starts_with(e.relpath, tg.path || '/'))) AS exists FROM tg WHERE tag = 'view:1'")
def tagged_items(spark, d):
    return B.tagged(_tags(spark, d), _docs(spark, d), "view:1")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def last_scans(spark, d):
    return B.last_per(T.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


_KIND = f"CASE WHEN {_EXT} = '.pdf' THEN 'pdf' WHEN {_EXT} = '.docx' THEN 'office' WHEN {_EXT} = '.txt' OR {_EXT} = '.js' AND false THEN 'text' WHEN {_EXT} = '.jpg' THEN 'image' WHEN {_EXT} = '.mp3' THEN 'audio' WHEN {_EXT} = '.zip' THEN 'archive' END"


@query(f"{W}, k AS (SELECT root, {_KIND} AS kind, relpath, size FROM entries), r AS (SELECT root, kind, row_number() OVER (PARTITION BY root, kind ORDER BY size DESC, relpath)::INT AS rank, relpath, size FROM k WHERE kind IS NOT NULL) SELECT * FROM r WHERE rank <= 50")
def largest_by_kind(spark, d):
    return B.largest_by_kind(_docs(spark, d))


@query(f"{W}, n AS (SELECT root, {_PAR} AS dir, relpath, {_NAME} AS name, row_number() OVER (PARTITION BY root, {_PAR} ORDER BY relpath) AS r FROM entries) SELECT root, dir, string_agg(name, '|' ORDER BY r) AS names FROM n WHERE r <= 40 GROUP BY root, dir")
def folder_profiles(spark, d):
    return B.folder_profiles(_docs(spark, d))


_STYLE = f"CASE WHEN regexp_matches({_NAME}, '^(19|20)\\d{{2}}-\\d{{2}}-\\d{{2}}') THEN 'YYYY-MM-DD' WHEN regexp_matches({_NAME}, '^(19|20)\\d{{6}}(\\D|$)') THEN 'YYYYMMDD' WHEN regexp_matches({_NAME}, '^(19|20)\\d{{2}}-\\d{{2}}(\\D|$)') THEN 'YYYY-MM' WHEN regexp_matches({_NAME}, '^(19|20)\\d{{2}}_\\d{{2}}(\\D|$)') THEN 'YYYY_MM' WHEN regexp_matches({_NAME}, '^(19|20)\\d{{4}}(\\D|$)') THEN 'YYYYMM' WHEN regexp_matches({_NAME}, '^(19|20)\\d{{2}}(\\D|$)') THEN 'YYYY' END"


@query(f"{W}, n AS (SELECT root, {_PAR} AS dir, {_STYLE} AS style FROM entries), p AS (SELECT root, dir, style, count(*) AS files FROM n WHERE style IS NOT NULL GROUP BY ALL) SELECT root, dir, style, files, files / sum(files) OVER (PARTITION BY root, dir) AS share FROM p QUALIFY row_number() OVER (PARTITION BY root, dir ORDER BY files DESC, style) = 1")
def naming_styles(spark, d):
    return B.naming_styles(_docs(spark, d))


@query(f"{_TAGS} SELECT split_part(tag, ':', 1) AS facet, count(DISTINCT tag) AS tags, count(*) AS items FROM tg GROUP BY ALL")
def tag_facets(spark, d):
    return B.facets(_tags(spark, d))


@query(f"{W}, n AS (SELECT root, {_PAR} AS dir, {_NAME} AS name FROM entries UNION ALL SELECT root, {_PAR}, upper({_NAME}) FROM entries WHERE doc_id % 9 = 0), k AS (SELECT root, dir, lower(name) AS key, count(DISTINCT name) AS names, min(name) AS first_name FROM n GROUP BY ALL) SELECT * FROM k WHERE names > 1")
def name_clashes(spark, d):
    e = _docs(spark, d)
    loud = e.filter(F.floor(F.col("entry_id") / 2) % 9 == 0).withColumn("relpath", F.concat(P.parent(F.col("relpath")), F.lit("/"), F.upper(P.basename(F.col("relpath")))))
    both = e.select("root", "relpath").union(loud.select("root", "relpath"))
    return B.name_clashes(both, nfkc_casefold(P.basename(F.col("relpath"))))


@query(f"""{W}, i AS (SELECT root, regexp_extract(relpath, '^(.*?node_modules)/', 1) AS inbox, relpath, CASE WHEN cur THEN sha256 END AS h FROM entries WHERE contains(relpath, '/node_modules/')),
 o AS (SELECT root, sha256 AS h, count(*) AS n FROM entries WHERE cur AND NOT contains(relpath, '/node_modules/') GROUP BY ALL)
SELECT i.root, inbox, relpath, coalesce(n, 0) AS elsewhere FROM i LEFT JOIN o ON i.root = o.root AND i.h = o.h""")
def inbox_files(spark, d):
    return B.inbox_files(_docs(spark, d), ["NODE_*", "in?ox"])


_ITEMS = "SELECT 'R' || r_regionkey AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || c_nationkey FROM customer"


@query("SELECT lower(r_name) || '/' || n_name || '/' || upper(c_name) AS path, 'C' || c_custkey AS item_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '/' || n_name, 'N' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def cloud_items(spark, d):
    r, n, c = (T.read(spark, d, x) for x in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    items = r.select(key("R", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    items = items.union(n.select(key("N", "n_nationkey"), "n_name", key("R", "n_regionkey"))).union(c.select(key("C", "c_custkey"), "c_name", key("N", "c_nationkey")))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    deep = c.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", F.lower("r_name"), "n_name", F.upper("c_name")).alias("path"))
    paths = deep.union(places.select(F.concat_ws("/", "r_name", "n_name"))).union(places.select(F.concat_ws("/", F.lit("nowhere"), "n_name")))
    return B.cloud_paths(items, paths)


@query("SELECT 'c' || o_custkey AS item, 'out' AS direction, o_orderpriority AS kind, 'o' || o_orderkey AS other FROM orders UNION ALL SELECT 'o' || o_orderkey, 'in', o_orderpriority, 'c' || o_custkey FROM orders")
def relations_both_ways(spark, d):
    o = T.read(spark, d, "orders")
    return B.relations_of(o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst")))


def _moved(spark, d):
    """The tree after some folders moved: (files before, moves, files after). Sources 0 (mod 4) move with all, 1 leave a part behind, 2 arrive with other contents."""
    e = _docs(spark, d).select("root", "relpath", "sha256", F.floor(F.col("entry_id") / 2).alias("i"), F.expr("try_cast(regexp_extract(relpath, '^src([0-9]+)/en/', 1) as int)").alias("n"))
    goes = F.coalesce((F.col("n") % 4).isin(0, 2) | ((F.col("n") % 4 == 1) & (F.col("i") % 3 == 0)), F.lit(False))
    to = F.concat(F.lit("bak/"), F.col("relpath"))
    moves = e.filter(goes).select("root", F.col("relpath").alias("old"), to.alias("new"))
    after = e.select("root", F.when(goes, to).otherwise(F.col("relpath")).alias("relpath"), F.when(goes & (F.col("n") % 4 == 2), F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return e.filter(goes).select("root", "relpath", "sha256"), moves, after


@query(f"""{W}, e AS (SELECT root, relpath, sha256, doc_id AS i, try_cast(regexp_extract(relpath, '^src([0-9]+)/en/', 1) AS INT) AS n FROM entries),
 g AS (SELECT *, coalesce(n % 4 IN (0, 2) OR (n % 4 = 1 AND i % 3 = 0), false) AS goes FROM e),
 a AS (SELECT root, CASE WHEN goes THEN 'bak/' || relpath ELSE relpath END AS relpath, CASE WHEN goes AND n % 4 = 2 THEN 'other' ELSE sha256 END AS sha256 FROM g),
 dirs AS (SELECT DISTINCT root, unnest({_anc('relpath')}) AS dir FROM a), c AS (SELECT DISTINCT root, unnest({_anc('relpath')}) AS dir FROM g WHERE goes),
 m AS (SELECT c.root, c.dir, count(*) AS files, count(*) FILTER (a.sha256 = g.sha256) AS same FROM c JOIN g ON g.root = c.root AND g.goes AND starts_with(g.relpath, c.dir || '/') LEFT JOIN a ON a.root = g.root AND a.relpath = 'bak/' || g.relpath WHERE c.dir <> '' GROUP BY ALL),
 q AS (SELECT root, dir FROM m WHERE same * 2 > files AND NOT EXISTS (SELECT 1 FROM dirs WHERE dirs.root = m.root AND dirs.dir = m.dir))
SELECT root, dir AS old_dir, 'bak/' || dir AS new_dir FROM q WHERE NOT EXISTS (SELECT 1 FROM q p WHERE p.root = q.root AND starts_with(q.dir, p.dir || '/'))""")
def folder_moves(spark, d):
    before, moves, after = _moved(spark, d)
    return H.folder_moves(moves, before, after)


_SNAP = "s AS (SELECT CASE WHEN event_id % 1000 < 500 THEN 'old/f' ELSE 'f' END || (user_id % 40) AS relpath, event_id AS taken_at, floor(value / 25)::BIGINT AS size, 0::BIGINT AS mtime_ns FROM events), g AS (SELECT 'f' || n AS item, 'old/f' || n AS relpath, NULL::BIGINT AS since, 3000::BIGINT AS until FROM range(40) t(n) UNION ALL SELECT 'f' || n, 'f' || n, 3000, NULL FROM range(40) t(n))"


@query(f"""WITH {_SNAP}, x AS (SELECT g.item, g.relpath, s.taken_at, s.size, s.mtime_ns FROM g JOIN s USING (relpath) WHERE (since IS NULL OR taken_at >= since) AND (until IS NULL OR taken_at < until)),
 n AS (SELECT *, CASE WHEN (relpath, size) IS NOT DISTINCT FROM (lag(relpath) OVER w, lag(size) OVER w) THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY item ORDER BY taken_at, relpath)),
 v AS (SELECT *, sum(new) OVER (PARTITION BY item ORDER BY taken_at, relpath)::BIGINT AS version FROM n)
SELECT item, relpath, version, size, mtime_ns, min(taken_at) AS first_seen, max(taken_at) AS last_seen, count(*) AS snapshots FROM v GROUP BY ALL""")
def snapshot_versions(spark, d):
    e = T.read(spark, d, "events")
    n = (F.col("user_id") % 40).cast("string")
    path = F.concat(F.when(F.col("event_id") % 1000 < 500, "old/f").otherwise("f"), n)
    shots = e.select(path.alias("relpath"), F.col("event_id").alias("taken_at"), F.floor(F.col("value") / 25).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"))
    items = e.select(F.concat(F.lit("f"), n).alias("item")).distinct()
    none = F.lit(None).cast("long")
    old = items.select("item", F.concat(F.lit("old/"), "item").alias("relpath"), none.alias("since"), F.lit(3000).cast("long").alias("until"))
    return H.versions(old.union(items.select("item", F.col("item"), F.lit(3000).cast("long"), none)), shots)


@query(f"""{W}, {T.OBS_SQL}, sh AS (SELECT root, 1 AS taken_at, relpath FROM entries UNION ALL SELECT root, 2, relpath FROM obs), k AS (SELECT DISTINCT root, taken_at, split_part(substr(relpath, 6), '/', 1) AS name, contains(substr(relpath, 6), '/') AS is_dir FROM sh WHERE starts_with(relpath, 'src1/')),
 l AS (SELECT DISTINCT root, split_part(substr(relpath, 6), '/', 1) AS name, contains(substr(relpath, 6), '/') AS is_dir FROM obs WHERE starts_with(relpath, 'src1/') AND size > 2000)
SELECT k.*, l.name IS NOT NULL AS exists_now FROM k LEFT JOIN l USING (root, name, is_dir)""")
def folder_as_of(spark, d):
    return H.folder_as_of(_shots(spark, d), T.second_observation(_docs(spark, d)).filter("size > 2000"), "src1")


@query("""WITH a AS (SELECT 'r' || (user_id % 9) AS root, event_id % 50 AS newer, min(event_id) AS seq FROM events WHERE event_type = 'error' GROUP BY ALL), k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY root ORDER BY seq DESC) <= 20)
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM events e WHERE event_type = 'purchase' AND 'r' || (e.user_id % 9) = k.root AND e.event_id % 50 = k.newer AND e.value < 5)""")
def alerts_kept(spark, d):
    e = T.read(spark, d, "events").select("event_type", "value", F.col("event_id").alias("seq"), F.concat(F.lit("r"), (F.col("user_id") % 9).cast("string")).alias("root"), (F.col("event_id") % 50).alias("newer"))
    return H.kept_alerts(e.filter("event_type = 'error'").select("root", "newer", "seq"), e.filter("event_type = 'purchase' AND value < 5").select("root", "newer"))


_MARKED = "e AS (SELECT root, relpath FROM entries UNION ALL SELECT root, source || '/' || lang || '/p' || (doc_id % 10) || '/.git/config' FROM entries JOIN documents USING (doc_id) WHERE m = 20), t AS (SELECT * FROM (VALUES ('docs', 'src1', 'app'), ('docs', 'src2/en/p3', 'normal'), ('docs', 'src2/en/p4', 'bundle'), ('docs', 'src4', 'inbox')) x(root, path, type))"


def _marked(spark, d):
    e = _docs(spark, d).select("root", "relpath", "is_dir", "sha256")
    docs = T.read(spark, d, "documents").filter("doc_id % 31 = 20")
    git = docs.select(F.lit("docs").alias("root"), F.concat("source", F.lit("/"), "lang", F.lit("/p"), (F.col("doc_id") % 10).cast("string"), F.lit("/.git/config")).alias("relpath"), F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("sha256"))
    types = spark.createDataFrame([("docs", "src1", "app"), ("docs", "src2/en/p3", "normal"), ("docs", "src2/en/p4", "bundle"), ("docs", "src4", "inbox")], "root string, path string, type string")
    return e.union(git), types


_CLOSED = f"{W}, {_MARKED}, c AS (SELECT root, path AS dir FROM t WHERE type IN ('bundle', 'app', 'exclude') UNION SELECT root, regexp_extract(relpath, '^(.*)/\\.git/', 1) FROM e WHERE contains(relpath, '/.git/') AND (root, regexp_extract(relpath, '^(.*)/\\.git/', 1)) NOT IN (SELECT root, path FROM t WHERE type = 'normal')), cl AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.root = c.root AND starts_with(c.dir, o.dir || '/')))"


@query(f"{_CLOSED} SELECT root, dir FROM cl")
def closed_folders(spark, d):
    e, types = _marked(spark, d)
    return H.closed_folders(types, e)


@query(f"{_CLOSED}, o AS (SELECT root, sha256, bool_and(EXISTS (SELECT 1 FROM cl WHERE cl.root = entries.root AND starts_with(entries.relpath, cl.dir || '/'))) AS shut FROM entries GROUP BY ALL) SELECT root, sha256 FROM o WHERE shut")
def closed_only_contents(spark, d):
    e, types = _marked(spark, d)
    return H.closed_only(e, H.closed_folders(types, e))


@query("SELECT DISTINCT 'lines' AS root, 'c/' || c_nationkey AS dir, 'c/' || c_nationkey || '/x/y' AS last, 3::BIGINT AS length FROM customer a WHERE c_nationkey % 5 <> 0 AND EXISTS (SELECT 1 FROM customer b WHERE a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey)")
def structure_chains(spark, d):
    c = T.read(spark, d, "customer")
    path = F.concat_ws("/", F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("x"), F.when(F.col("c_nationkey") % 5 != 0, F.lit("y")), F.col("c_custkey").cast("string"), F.lit("f"))
    broken = F.concat_ws("/", F.lit("c"), F.col("c_nationkey").cast("string"), F.lit("x"), F.lit("own"))
    rows = c.select(path.alias("relpath")).union(c.filter("c_nationkey % 5 = 0").select(broken)).distinct()
    return H.chains(rows.select(F.lit("lines").alias("root"), "relpath", F.lit(False).alias("is_dir")))


@query(f"""{W}, s AS (SELECT *, try_cast(regexp_extract(relpath, '^src([0-9]+)/', 1) AS INT) % 4 AS n FROM entries)
SELECT root, relpath AS old, CASE WHEN n = 0 AND NOT (relpath LIKE 'src%/en/%') THEN 'archive/' || relpath ELSE relpath END AS relpath, coalesce(n = 1 OR (n = 0 AND relpath LIKE 'src%/en/%'), false) AS gone FROM s""")
def plan_effects(spark, d):
    e = _docs(spark, d)
    tops = e.select("root", F.substring_index("relpath", "/", 1).alias("path")).distinct().withColumn("n", F.expr("try_cast(regexp_extract(path, '^src([0-9]+)$', 1) as int) % 4")).filter("n IN (0, 1)")
    ops = tops.select("root", "path", F.when(F.col("n") == 0, F.concat(F.lit("archive/"), "path")).alias("dest"))
    ops = ops.union(tops.filter("n = 0").select("root", F.concat("path", F.lit("/en")), F.lit(None).cast("string")))
    return H.after_plan(e, ops)


@query(f"""{W}, f AS (SELECT DISTINCT root, split_part(relpath, '/', 1) AS top FROM entries), a AS (SELECT DISTINCT root, unnest(list_append({_anc('relpath')}, relpath)) AS p FROM entries)
SELECT f.root, f.top AS relpath, count(a.p) AS below, count(a.p) >= 40 AS over FROM f LEFT JOIN a ON a.root = f.root AND starts_with(a.p, f.top || '/') GROUP BY ALL""")
def deletion_guard(spark, d):
    e = _docs(spark, d)
    return H.deletion_guard(e, e.select("root", F.substring_index("relpath", "/", 1).alias("relpath")).distinct(), 40)


@query(f"""{W}, k AS (SELECT root, relpath FROM entries WHERE starts_with(relpath, 'src1/en/') OR relpath LIKE '%.iso' OR relpath LIKE 'src2/%/[ab]2%' OR regexp_matches(relpath, '^src2/.*/1[0-4][^/]*$'))
SELECT DISTINCT root, dir FROM (SELECT root, unnest({_anc('relpath')}) AS dir FROM k) WHERE dir <> ''""")
def protected_folders(spark, d):
    kept = spark.createDataFrame([("docs", "src1/en")], "root string, path string")
    return H.protected_folders(H.kept_or_allowed(_docs(spark, d), kept, ["*.iso", "src2/*/1[0-4]*"]))


@query(f"""{W}, {_FOUND}, sp AS (SELECT relpath FROM entries WHERE starts_with(relpath, 'src1/en/') OR relpath LIKE '%.iso' OR regexp_matches(relpath, '^src2/.*/1[0-4]')),
ov AS (SELECT root, 'old-version' AS category, relpath, false AS is_dir, 1::BIGINT AS files, size, false AS needs_review FROM entries WHERE regexp_matches(relpath, '[02468]\\.mp3$'))
SELECT root, category, relpath, is_dir, files, size, needs_review FROM (SELECT * FROM found WHERE category <> 'vm-image' UNION ALL SELECT * FROM ov) f
WHERE relpath NOT IN (SELECT relpath FROM sp) AND NOT (is_dir AND EXISTS (SELECT 1 FROM sp WHERE starts_with(sp.relpath, f.relpath || '/')))""")
def hygiene_findings_spared(spark, d):
    e, p = _docs(spark, d), F.col("relpath")
    kept = spark.createDataFrame([("docs", "src1/en")], "root string, path string")
    spared = H.kept_or_allowed(e, kept, ["*.iso", "src2/*/1[0-4]*"])
    mp3 = e.filter(p.endswith(".mp3"))
    versions = mp3.select("root", p.alias("old"), F.when(p.rlike(r"[02468]\.mp3$"), P.parent(p)).otherwise(F.concat(p, F.lit(".gone"))).alias("newer"))
    return Y.findings(e, spared=spared, versions=versions, disabled=["vm-image"])


_SUG = "sg AS (SELECT sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'big' WHEN doc_id % 3 = 1 THEN 'small' ELSE 'other' END AS model, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 2 END AS prompt_version, doc_id AS created_at, lang || '/' || source AS dest FROM documents)"


def _suggestions(spark, d):
    t = T.read(spark, d, "documents")
    i = F.col("doc_id")
    model = F.when(i % 3 == 0, "big").when(i % 3 == 1, "small").otherwise("other")
    return t.select(F.sha2("text", 256).alias("sha256"), model.alias("model"), F.when(i % 10 == 0, 1).otherwise(2).alias("prompt_version"), i.alias("created_at"), F.concat_ws("/", "lang", "source").alias("dest"))


@query(f"""WITH {_SUG}, n AS (SELECT sha256, model, dest FROM sg WHERE prompt_version = 2 QUALIFY row_number() OVER (PARTITION BY sha256, model ORDER BY created_at DESC, dest DESC) = 1), c AS (SELECT DISTINCT sha256 FROM sg)
SELECT c.sha256, CASE WHEN a.dest IS NOT NULL THEN 'big' ELSE 'small' END AS model, coalesce(a.dest, b.dest) AS dest FROM c LEFT JOIN n a ON a.sha256 = c.sha256 AND a.model = 'big' LEFT JOIN n b ON b.sha256 = c.sha256 AND b.model = 'small' WHERE a.dest IS NOT NULL OR b.dest IS NOT NULL""")
def suggestion_lookup(spark, d):
    s = _suggestions(spark, d)
    return D.suggestion_lookup(s.select("sha256").distinct(), s, "big", "small", 2)


@query("""WITH a AS (SELECT conv_id * 100 + turn AS id, [(length(text) + k * turn) % 9 FOR k IN range(8)] AS picks FROM conversations), e AS (SELECT id, unnest(picks) AS n, unnest(range(8)) AS pos FROM a),
 o AS (SELECT id, 'd' || (n % 4) AS dest, min(pos) AS pos FROM e WHERE n BETWEEN 1 AND 6 GROUP BY ALL), r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos)::INT AS rank, dest FROM o) SELECT * FROM r WHERE rank <= 5""")
def picked_destinations(spark, d):
    c = T.read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ((F.length("text") + k * F.col("turn")) % 9).cast("int")).alias("picks"))
    options = c.select("id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).withColumn("dest", F.concat(F.lit("d"), (F.col("n") % 4).cast("string")))
    return D.picked_destinations(c, options)


_DEC = "dc AS (SELECT event_id AS seq, 'h' || (user_id % 60) AS sha256, 'in/' || event_id AS path, 'out/' || (event_id % 7) AS dest, CASE WHEN event_type = 'click' THEN 'accept' WHEN event_type = 'error' THEN 'reject' ELSE 'skip' END AS decision, 'p' || (event_id % 40) AS plan_id, 't' || (user_id % 30) AS tag FROM events)"


def _decisions(spark, d):
    e, t = T.read(spark, d, "events"), F.col("event_type")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    i, u = F.col("event_id"), F.col("user_id")
    how = F.when(t == "click", "accept").when(t == "error", "reject").otherwise("skip")
    return e.select(i.alias("seq"), text("h", u % 60).alias("sha256"), text("in/", i).alias("path"), text("out/", i % 7).alias("dest"), how.alias("decision"), text("p", i % 40).alias("plan_id"), text("t", u % 30).alias("tag"))


@query(f"WITH {_DEC} SELECT sha256, path, dest FROM dc WHERE decision = 'accept' AND plan_id NOT IN (SELECT plan_id FROM dc WHERE decision = 'reject' AND seq % 211 = 0) QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY seq DESC) = 1")
def decision_examples(spark, d):
    x = _decisions(spark, d)
    return D.decision_examples(x, x.filter("decision = 'reject' AND seq % 211 = 0").select("plan_id").distinct())


@query(f"WITH {_DEC} SELECT tag, count(*) AS rejects FROM dc WHERE decision = 'reject' GROUP BY tag HAVING count(*) >= 2 ORDER BY rejects DESC, tag LIMIT 20")
def rejected_tags(spark, d):
    return D.rejected_tags(_decisions(spark, d))


@query(f"WITH {_DEC}, s AS (SELECT 'h' || k AS sha256, 'big' AS model, 'out/' || (k % 7) AS dest FROM range(40) t(k)) SELECT plan_id, path, dc.sha256, model, s.dest AS suggested, dc.dest, CASE WHEN s.dest IS NULL THEN 'manual' WHEN s.dest = dc.dest THEN 'accept' ELSE 'changed' END AS decision FROM dc LEFT JOIN s USING (sha256)")
def logged_decisions(spark, d):
    x = _decisions(spark, d)
    k = F.expr("cast(substring(sha256, 2) as int)")
    s = x.select("sha256", k.alias("k")).distinct().filter("k < 40").select("sha256", F.lit("big").alias("model"), F.concat(F.lit("out/"), (F.col("k") % 7).cast("string")).alias("dest"))
    return D.logged_decisions(x, s)


@query(f"WITH {_DEC}, e AS (SELECT sha256 AS id, seq::INT AS rank, dest FROM dc WHERE decision = 'accept'), h AS (SELECT sha256 AS id, seq::INT AS rank, 'idx/' || (seq % 5) AS dest FROM dc WHERE decision = 'skip'), b AS (SELECT id, dest, min((p, rank)) AS a FROM (SELECT *, 0 AS p FROM e UNION ALL SELECT *, 1 FROM h) GROUP BY ALL), r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY a, dest)::INT AS n, dest FROM b) SELECT * FROM r WHERE n <= 8")
def destination_candidates(spark, d):
    x = _decisions(spark, d).withColumn("rank", F.col("seq").cast("int"))
    examples = x.filter("decision = 'accept'").select(F.col("sha256").alias("id"), "rank", "dest")
    hits = x.filter("decision = 'skip'").select(F.col("sha256").alias("id"), "rank", F.concat(F.lit("idx/"), (F.col("seq") % 5).cast("string")).alias("dest"))
    return D.destination_candidates(examples, hits, 8)


@query("""WITH l AS (SELECT doc_id, quality, toxic FROM labels), a AS (SELECT 'docs' AS root, doc_id::VARCHAR AS path, quality, toxic FROM l)
SELECT 'add' AS op, root, path, 'quality:' || quality AS tag, NULL AS name, NULL AS value, 'ai' AS source FROM a WHERE quality IS NOT NULL UNION ALL SELECT 'add', root, path, 'toxic:' || toxic, NULL, NULL, 'ai' FROM a WHERE toxic IS NOT NULL
UNION ALL SELECT 'attr-set', root, path, NULL, CASE WHEN quality = 1 THEN 'grade' ELSE 'state' END, 'q' || quality, 'ai' FROM a WHERE quality IS NOT NULL UNION ALL SELECT DISTINCT 'attr-def', NULL, NULL, NULL, 'grade', 'text', 'ai' FROM a WHERE quality = 1""")
def accepted_events(spark, d):
    a = T.read(spark, d, "labels")
    tag = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ":"), F.col(c).cast("string")))
    tags = F.filter(F.array(tag("quality"), tag("toxic")), lambda t: t.isNotNull())
    rows = a.select(F.lit("docs").alias("root"), F.col("doc_id").cast("string").alias("path"), tags.alias("tags"), F.when(F.col("quality") == 1, "grade").otherwise("state").alias("name"), F.lit("text").alias("kind"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    return D.accepted_events(rows, spark.createDataFrame([("state",)], "name string"))


@query("SELECT n_name AS root, m AS model, CASE WHEN c AND n_nationkey % 3 <> 0 THEN 'cloud not allowed' END AS error FROM nation, (VALUES ('big', true), ('small', true), ('local', false)) t(m, c)")
def model_routes(spark, d):
    roots = T.read(spark, d, "nation").select(F.col("n_name").alias("root"), (F.col("n_nationkey") % 3 == 0).alias("allow_cloud"))
    return D.model_routes(roots, [("big", True), ("small", True), ("local", False)])


@query(f"WITH {_DEC}, s AS (SELECT DISTINCT plan_id, path FROM dc WHERE decision = 'reject'), t AS (SELECT DISTINCT plan_id FROM dc WHERE decision = 'accept' AND seq % 4 = 0) SELECT plan_id, count(*) AS ops, count(*) FILTER (decision <> 'reject') AS run, coalesce(sum(seq) FILTER (decision <> 'reject'), 0)::BIGINT AS bytes, CASE WHEN plan_id IN (SELECT plan_id FROM t) THEN 'applied' ELSE 'draft' END AS state FROM dc GROUP BY plan_id")
def plan_summary(spark, d):
    x = _decisions(spark, d).withColumn("size", F.col("seq"))
    state = x.filter("decision = 'accept' AND seq % 4 = 0").select("plan_id", F.lit("applied").alias("state")).distinct()
    return D.plan_summary(x, state, x.filter("decision = 'reject'").select("plan_id", "path"))


@query("SELECT role AS model, count(*) FILTER (turn % 4 <> 3) AS ok, count(*) FILTER (turn % 4 = 3) AS failed, avg(length(text) / 10.0) FILTER (turn % 4 <> 3) AS seconds, avg(length(text)) FILTER (turn % 4 <> 3) AS tokens FROM conversations GROUP BY role")
def model_evaluation(spark, d):
    c = T.read(spark, d, "conversations")
    return D.model_evaluation(c.select(F.col("role").alias("model"), F.when(F.col("turn") % 4 == 3, "failed").alias("error"), (F.length("text") / F.lit(10.0)).alias("seconds"), F.length("text").alias("tokens")))


@query(f"{_TAGS}, i AS (SELECT DISTINCT CASE WHEN seq % 5 = 0 THEN 'paint' ELSE op END AS op, root, path, tag FROM ev) SELECT op, count(*) FILTER (op <> 'paint' AND NOT (op = 'add' AND tg.tag IS NOT NULL)) AS added, count(*) FILTER (op = 'add' AND tg.tag IS NOT NULL) AS known, count(*) FILTER (op = 'paint') AS invalid FROM i LEFT JOIN tg USING (root, path, tag) GROUP BY op")
def import_counts(spark, d):
    log = _log(spark, d)
    incoming = log.select(F.when(F.col("seq") % 5 == 0, "paint").otherwise(F.col("op")).alias("op"), "root", "path", "tag")
    return D.import_counts(incoming, _tags(spark, d), ["add", "remove"])


@query("""WITH t AS (SELECT 'u' || user_id AS root, max(event_id) FILTER (event_type = 'view') AS s, max(event_id) FILTER (event_type = 'purchase') AS y, max(event_id) FILTER (event_type = 'error') AS f, bool_or(event_type = 'click' AND value < 2) AS busy, (SELECT max(event_id) FROM events) AS now FROM events GROUP BY user_id)
SELECT root, coalesce(s IS NOT NULL AND NOT busy AND (now - s >= 500 OR coalesce(y, 0) > s) AND (f IS NULL OR now - f >= 600), false) AS due FROM t""")
def refresh_due(spark, d):
    e = T.read(spark, d, "events")
    last = lambda k, n: F.max(F.when(F.col("event_type") == k, F.col("event_id"))).alias(n)
    busy = F.max((F.col("event_type") == "click") & (F.col("value") < 2)).alias("sync_busy")
    t = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("root")).agg(last("view", "scanned_at"), last("purchase", "sync_ended_at"), last("error", "failed_at"), busy)
    t = t.withColumn("now", F.lit(e.agg(F.max("event_id")).first()[0]))
    return D.refresh_due(t, F.col("now"), 500)


@query(f"{W} SELECT 'files' AS section, root AS key, count(*) AS value FROM entries GROUP BY root UNION ALL SELECT 'kinds', kind, count(*) FROM (SELECT {_KIND} AS kind FROM entries) WHERE kind IS NOT NULL GROUP BY kind UNION ALL SELECT 'new', {_PAR}, count(*) FROM entries WHERE mtime_ns >= 90000000000000 GROUP BY ALL UNION ALL SELECT 'unhashed', root, count(*) FROM entries WHERE NOT cur GROUP BY root")
def digest(spark, d):
    e = _docs(spark, d)
    count = lambda df, key: df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value"))
    root = F.col("root")
    return D.digest({"files": count(e, root), "kinds": count(e.withColumn("k", N.kind(F.col("relpath"))).filter("k IS NOT NULL"), F.col("k")), "new": count(e.filter("mtime_ns >= 90000000000000"), P.parent(F.col("relpath"))), "unhashed": count(B.hash_pending(e), root)})


@query(f"{_TAGS} SELECT DISTINCT tag FROM tg UNION SELECT 'alias:' || (user_id % 3) FROM events UNION SELECT split_part(tag, ':', 1) FROM tg")
def all_tag_names(spark, d):
    t = _tags(spark, d)
    alias = T.read(spark, d, "events").select(F.concat(F.lit("alias:"), (F.col("user_id") % 3).cast("string")).alias("tag"))
    return t.select("tag").union(alias).union(t.select(F.substring_index("tag", ":", 1))).distinct()


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || 'B' ELSE printf('%.1fKB', n_chars / 1024.0) END AS human, (doc_id % 5 + 0.5) * 1048576 AS parsed, 'src_' || doc_id || '_x.y-z' AS slug, printf('%d:%02d:%02d', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) AS label, 'f' || lpad(length(doc_id::VARCHAR)::VARCHAR, 9, '0') || doc_id || 'x' AS natural, source || ':' || lang AS tag, 'm' || doc_id AS model, CASE WHEN doc_id % 2 = 0 THEN 'high' END AS effort, 'local' AS endpoint FROM documents")
def name_functions(spark, d):
    t = T.read(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    parts = N.model_parts(F.concat(F.lit("m"), i, F.when(F.col("doc_id") % 2 == 0, ":high").otherwise(""), F.lit("@local")))
    return t.select(
        "doc_id",
        N.human_size(F.col("n_chars").cast("long")).alias("human"),
        N.parse_size(F.concat((F.col("doc_id") % 5).cast("string"), F.lit(".5 mb"))).cast("double").alias("parsed"),
        N.slug(F.concat(F.lit("  src  "), i, F.lit("*/x.y-z!"))).alias("slug"),
        N.time_label(F.col("n_chars") + F.lit(0.7)).alias("label"),
        P.natural_key(F.concat(F.lit("F"), i, F.lit("X"))).alias("natural"),
        N.normalize_tag(F.concat(F.lit("  "), "source", F.lit(" :  "), "lang", F.lit(" "))).alias("tag"),
        parts["id"].alias("model"),
        parts["effort"].alias("effort"),
        parts["endpoint"].alias("endpoint"),
    )


@query("SELECT doc_id, 'Ab_c_' || doc_id || CASE WHEN doc_id % 4 = 0 THEN repeat('é', 100 - length('Ab_c_' || doc_id) // 2 - (length('Ab_c_' || doc_id) % 2)) ELSE '' END || '.pdf' AS name FROM documents")
def cleaned_names(spark, d):
    t = T.read(spark, d, "documents")
    new = F.concat(F.lit("  .Ab/c:"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, F.repeat(F.lit("é"), F.lit(140))).otherwise(".PDF"), F.lit(" "))
    return t.select("doc_id", N.clean_name(new, F.lit("scan.0001.PDF")).alias("name"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN (conv_id * 10 + turn) END AS n FROM conversations")
def json_answers(spark, d):
    c = T.read(spark, d, "conversations")
    body = F.concat(F.lit('{"n": '), (F.col("conv_id") * 10 + F.col("turn")).cast("string"), F.lit(', "s": "}{"}'))
    k = F.col("turn") % 4
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(k == 2, F.concat(F.lit("It is "), body, F.lit(" then"))).otherwise("no { answer")
    return c.select("conv_id", "turn", F.get_json_object(N.json_answer(text), "$.n").cast("long").alias("n"))


@query(f"{W} SELECT relpath, regexp_matches(relpath, '^src[12]/') AND {_EXT} = '.txt' AS left_out, contains(relpath, '~') AS lock, regexp_replace(relpath, '(?i)(SRC1)', '[\\1]', 'g') AS marked FROM entries")
def path_patterns(spark, d):
    p = F.col("relpath")
    return _docs(spark, d).select("relpath", P.excluded(p, ["src[12]/*.txt"]).alias("left_out"), P.excluded(p, ["*/~*"]).alias("lock"), highlight(p, "Src1").alias("marked"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id * 1000)::VARCHAR END AS number, CASE WHEN doc_id % 3 <> 0 THEN '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS date, CASE WHEN lang IN ('en', 'de') THEN lang END AS choice, doc_id * 1000 >= 5000 AS large FROM documents")
def attribute_values(spark, d):
    t = T.read(spark, d, "documents")
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    number = N.parse_attr(F.lit("number"), F.concat(i.cast("string"), F.when(i % 2 == 0, ",000").otherwise("x")), none)
    date = N.parse_attr(F.lit("date"), F.concat(F.lit("2024-02-"), F.when(i % 3 == 0, "31").otherwise(F.lpad((i % 28 + 1).cast("string"), 2, "0"))), none)
    choice = N.parse_attr(F.lit("choice"), F.col("lang"), F.array(F.lit("en"), F.lit("de")))
    return t.select("doc_id", number.alias("number"), date.alias("date"), choice.alias("choice"), N.match_attr(F.lit("number"), (i * 1000).cast("string"), ">=", "5,000").alias("large"))


@query(f"{W}, x AS (SELECT sha256(text) AS sha256, 'Größe ＡＢＣ ' || doc_id AS text FROM documents) SELECT sha256 FROM x WHERE contains(text, '1') GROUP BY ALL")
def search_text_folded(spark, d):
    x = T.read(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("Größe ＡＢＣ "), F.col("doc_id").cast("string")).alias("text"))
    return S.text_matches(x, ["GRÖSSE", "abc", "１"]).select("sha256").distinct()


@query()
def similar_folders(spark, d):
    """Folder index: paths three times, then the first names; asked with the benchmark's texts."""
    p = B.folder_profiles(_docs(spark, d))
    text = F.concat_ws(" ", F.array_repeat(F.col("dir"), 3), "names")
    return S.similar(p.select(F.concat_ws(":", "root", "dir").alias("id"), F.array_join(F.array(text), " ").alias("text")), T.read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("WITH a AS (SELECT event_type AS name, count(DISTINCT user_id) AS items FROM events GROUP BY ALL) SELECT n AS name, coalesce(items, 0) AS items FROM (SELECT DISTINCT event_type AS n FROM events UNION SELECT 'unused') LEFT JOIN a ON n = name")
def attribute_counts(spark, d):
    e = T.read(spark, d, "events")
    defs = e.select(F.col("event_type").alias("name")).distinct().union(spark.createDataFrame([("unused",)], "name string"))
    return defs.join(e.groupBy(F.col("event_type").alias("name")).agg(F.count_distinct("user_id").alias("items")), "name", "left").fillna(0, ["items"])


@query("SELECT count(DISTINCT sha256(text)) AS contents, count(DISTINCT sha256(text)) FILTER (doc_id % 3 = 0) AS indexed FROM documents")
def indexed_counts(spark, d):
    h = F.sha2("text", 256)
    return T.read(spark, d, "documents").agg(F.count_distinct(h).alias("contents"), F.count_distinct(F.when(F.col("doc_id") % 3 == 0, h)).alias("indexed"))


@query(f"{W} SELECT e.root, e.relpath, length(x.text) AS chars, l.quality, l.toxic FROM entries e LEFT JOIN (SELECT DISTINCT sha256(text) AS sha256, text FROM documents WHERE doc_id % 2 = 0) x USING (sha256) LEFT JOIN (SELECT sha256(text) AS sha256, max(quality) AS quality, max(toxic) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1) l USING (sha256)")
def entries_with_analyses(spark, d):
    docs = T.read(spark, d, "documents")
    h = F.sha2("text", 256).alias("sha256")
    extracts = docs.filter("doc_id % 2 = 0").select(h, F.length("text").cast("long").alias("chars")).distinct()
    analyses = T.read(spark, d, "labels").join(docs.select("doc_id", h), "doc_id").groupBy("sha256").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return _docs(spark, d).join(extracts, "sha256", "left").join(analyses, "sha256", "left").select("root", "relpath", "chars", "quality", "toxic")


@query("SELECT CASE WHEN conv_id % 3 = 0 THEN 'big' ELSE 'small' END AS model, turn, length(text) AS input_tokens FROM conversations WHERE conv_id >= (SELECT max(conv_id) - 20 FROM conversations)")
def usage_since(spark, d):
    c = T.read(spark, d, "conversations")
    last = c.agg(F.max("conv_id")).first()[0]
    return c.filter(F.col("conv_id") >= (last or 0) - 20).select(F.when(F.col("conv_id") % 3 == 0, "big").otherwise("small").alias("model"), "turn", F.length("text").cast("long").alias("input_tokens"))


@query(f"{_TAGS} SELECT tag, items FROM (SELECT tag, count(*) AS items FROM tg GROUP BY tag) ORDER BY items DESC, tag LIMIT 80")
def top_tags(spark, d):
    return _tags(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("items"), "tag").limit(80)


_NESTED = f"{W}, k AS (SELECT DISTINCT root, unnest({_anc('relpath')}) AS dir FROM entries)"


@query(f"{_NESTED} SELECT root, dir, row_number() OVER (PARTITION BY root ORDER BY string_split(dir, '/'))::INT AS place, row_number() OVER (PARTITION BY root ORDER BY string_split(dir, '/') DESC)::INT AS undo FROM k WHERE dir <> ''")
def parents_first(spark, d):
    from pyspark.sql import Window

    k = _docs(spark, d).select("root", F.explode(P.ancestors(F.col("relpath"))).alias("dir")).filter("dir <> ''").distinct()
    w, parts = Window.partitionBy("root"), P.parts(F.col("dir"))
    return k.select("root", "dir", F.row_number().over(w.orderBy(parts)).alias("place"), F.row_number().over(w.orderBy(parts.desc())).alias("undo"))


@query(f"WITH {T.LINES_SQL}, x AS (SELECT *, count(*) OVER (PARTITION BY root) AS total FROM entries WHERE contains(relpath, '/1995/')) SELECT root, relpath, size, total FROM x ORDER BY relpath LIMIT 100")
def search_page(spark, d):
    found = S.find(_lines(spark, d), words="/1995/")
    total = found.groupBy("root").agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("relpath").limit(100).join(total, "root").select("root", "relpath", "size", "total")


@query(f"{W} SELECT root, relpath, sha256 FROM entries e WHERE cur AND NOT EXISTS (SELECT 1 FROM entries r WHERE r.doc_id % 3 = 0 AND r.relpath = e.relpath AND r.sha256 = e.sha256)")
def not_yet_reviewed(spark, d):
    e = _docs(spark, d)
    done = e.filter(F.floor(F.col("entry_id") / 2) % 3 == 0).select("root", "relpath", "sha256")
    return e.filter(Y.current_hash()).select("root", "relpath", "sha256").join(done, ["root", "relpath", "sha256"], "left_anti")


@query(f"{_TAGS}, i AS (SELECT 'add' AS op, root, path, tag FROM tg) SELECT op, root, path, tag FROM i")
def exported_events(spark, d):
    return _tags(spark, d).select(F.lit("add").alias("op"), "root", "path", "tag")


_TYPES = "ty AS (SELECT 'src' || (user_id % 20) || CASE WHEN user_id % 3 = 0 THEN '/en' ELSE '' END AS path, ['normal', 'archive', 'dated', 'inbox', 'bundle', 'numbered'][arg_max(event_id, event_id) % 6 + 1] AS type FROM events WHERE user_id % 20 < 14 GROUP BY 1)"


@query(f"""{W}, {_TYPES}, k AS (SELECT DISTINCT root, {_PAR} AS dir FROM entries), s AS (SELECT k.root, k.dir, ty.type FROM k JOIN ty ON ty.path = k.dir),
 h AS (SELECT k.root, k.dir, ty.type, ty.path, row_number() OVER (PARTITION BY k.root, k.dir ORDER BY length(ty.path) DESC) AS r FROM k JOIN ty ON starts_with(k.dir, ty.path || '/') WHERE ty.type NOT IN ('dated', 'numbered') AND NOT EXISTS (SELECT 1 FROM s WHERE s.dir = k.dir))
SELECT root, dir, type, 'set' AS origin, dir AS from_path FROM s UNION ALL SELECT root, dir, type, 'inherited', path FROM h WHERE r = 1 AND type <> 'normal'""")
def folder_types_inherited(spark, d):
    u, i = F.col("user_id"), F.col("event_id")
    path = F.concat(F.lit("src"), (u % 20).cast("string"), F.when(u % 3 == 0, "/en").otherwise(""))
    names = F.array(*[F.lit(x) for x in ("normal", "archive", "dated", "inbox", "bundle", "numbered")])
    types = T.read(spark, d, "events").filter(u % 20 < 14).groupBy(path.alias("path")).agg(F.element_at(names, (F.max(i) % 6 + 1).cast("int")).alias("type")).withColumn("root", F.lit("docs"))
    return M.set_folder_types(_docs(spark, d).select("root", P.parent(F.col("relpath")).alias("dir")).distinct(), types)


@query()
def folded_state(spark, d):
    """All tables of the fold as rows of one; tested against a sequential fold."""
    out = None
    for name, df in G.fold(T.full_log(T.read(spark, d, "events")), [*G.PLACED, "aliases", "parents"]).items():
        place = [c for c in ("root", "path", "src", "alias") if c in df.columns]
        rows = df.select(F.lit(name).alias("table"), F.concat_ws("/", *place).alias("place"), F.concat_ws("|", *[c for c in df.columns if c not in place]).alias("facts"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT 'c' || c_custkey AS alias, 'c' || (c_custkey // (c_custkey & -c_custkey)) AS tag FROM customer WHERE c_custkey % 2 = 0 AND c_custkey > 0")
def alias_names(spark, d):
    k = T.read(spark, d, "customer").filter("c_custkey % 2 = 0 AND c_custkey > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("alias"), F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("tag"))
    return K.canonical_names(k)


@query("SELECT 'docs' AS root, 'd' || c_custkey AS src, CASE WHEN c_custkey % 5 = 4 THEN 'out/d' || c_custkey ELSE 'd' || (c_custkey + 1) END AS dst, least(4 - c_custkey % 5, (SELECT max(c_custkey) FROM customer) - c_custkey)::INTEGER AS level, false AS cyclic FROM customer")
def moves_ordered(spark, d):
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    moves = T.read(spark, d, "customer").select(F.lit("docs").alias("root"), name(k).alias("src"), F.when(k % 5 == 4, F.concat(F.lit("out/"), name(k))).otherwise(name(k + 1)).alias("dst"))
    return K.ordered_moves(moves).drop("place")


@query(f"""{_EFF}, {_ATTR}, nv AS (SELECT e.root, e.relpath, va.value, row_number() OVER (PARTITION BY e.root, e.relpath ORDER BY length(va.path) DESC) AS r FROM entries e JOIN va ON va.root = e.root AND va.name = 'view' AND (e.relpath = va.path OR starts_with(e.relpath, va.path || '/'))),
 a AS (SELECT 'tagged' AS name, root, relpath FROM entries e WHERE {_EXT} IN ('.txt', '.pdf', '.docx') AND EXISTS (SELECT 1 FROM ef WHERE ef.relpath = e.relpath AND ef.tag = 'view:1') AND NOT EXISTS (SELECT 1 FROM ef WHERE ef.relpath = e.relpath AND ef.tag = 'click:2') ORDER BY root, relpath LIMIT 5000),
 b AS (SELECT 'valued', e.root, e.relpath FROM entries e JOIN nv ON nv.root = e.root AND nv.relpath = e.relpath AND nv.r = 1 WHERE e.size <= 5000 AND nv.value::DOUBLE > 500 ORDER BY e.root, e.relpath LIMIT 5000)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def saved_searches(spark, d):
    entries = _docs(spark, d).withColumn("gone_at", F.lit(None).cast("long"))
    log = T.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("docs").alias("root"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.when(F.col("user_id") % 3 == 0, "/en").otherwise("")).alias("path"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), F.lit("attr-set").alias("op"))
    saved = {"tagged": "tag=view:1&not=click:2&kind=document&limit=5000", "valued": "attr=view%3E500&max_size=5000&limit=5000"}
    out = None
    for name, query_ in saved.items():
        rows = V.search(query_, entries, tags=_tags(spark, d), attributes=M.last_values(log), kinds={"view": "number"}).select(F.lit(name).alias("name"), "root", "relpath")
        out = rows if out is None else out.union(rows)
    return out


@query(f"{_TAGS} SELECT root, b AS base, 'item' AS fact, path, tag AS key FROM tg, (SELECT unnest(['src1', 'src2', 'src3/en']) AS b) WHERE path = b OR starts_with(path, b || '/')")
def detached_facts(spark, d):
    bases = spark.createDataFrame([("docs", b) for b in ("src1", "src2", "src3/en")], "root string, base string")
    return A.detached({"items": _tags(spark, d)}, bases).select("root", "base", "fact", "path", "key")


@query(f"""{W} SELECT root, CASE WHEN doc_id % 3 <> 0 AND doc_id % 11 = 0 THEN 'moved/' || relpath ELSE relpath END AS relpath, 1::BIGINT AS first_seen, CASE WHEN doc_id % 3 <> 0 THEN 2 ELSE 1 END AS last_seen, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS missing_count,
 CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 2 END AS gone_at, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'scan' END AS gone_by FROM entries""")
def catalog_after_a_scan(spark, d):
    """A third of the files is missing, too much for one scan: only those that were missing before are gone."""
    i = F.floor(F.col("entry_id") / 2)
    e = _docs(spark, d)
    known = e.select("root", "relpath", "is_dir", "size", "mtime_ns", "inode", F.lit(1).cast("long").alias("first_seen"), F.lit(1).cast("long").alias("last_seen"), F.when(i % 4 == 0, 1).otherwise(0).alias("missing_count"), F.lit(None).cast("long").alias("gone_at"), F.lit(None).cast("string").alias("gone_by"))
    seen = e.filter(i % 3 != 0).select("root", F.when(i % 11 == 0, F.concat(F.lit("moved/"), "relpath")).otherwise(F.col("relpath")).alias("relpath"), "is_dir", "size", "mtime_ns", "inode")
    return R.scan_step(known, seen, 2, least=1).select("root", "relpath", "first_seen", "last_seen", "missing_count", "gone_at", "gone_by")


@query("""WITH l AS (SELECT 'r' || (user_id % 3) AS root, 'p' || (event_id % 70) AS path, event_type FROM events) SELECT DISTINCT root, path FROM l WHERE event_type IN ('error', 'view') AND substr(path, 2)::INTEGER < 50""")
def reflected_deletions(spark, d):
    e = T.read(spark, d, "events")
    path = F.concat(F.lit("p"), (F.col("event_id") % 70).cast("string"))
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("2026/01/01 10:00:00 INFO  : "), path, F.lit(": Deleted"))).when(F.col("event_type") == "view", F.concat(F.lit("Deleting item from Microsoft OneDrive: ./"), path)).otherwise(F.concat(F.lit("INFO  : "), path, F.lit(": Copied (new)")))
    lines = e.select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("root"), said.alias("line"))
    expected = e.select(F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("root"), F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("path")).distinct()
    return R.reflected(lines, expected)


@query("WITH x AS (SELECT DISTINCT sha256(text) AS sha256, text FROM documents WHERE text IS NOT NULL) SELECT sha256 FROM x WHERE contains(lower(text), 'license') AND contains(lower(text), 'mit')")
def search_stored_index(spark, d):
    """The index is written in two deltas and merged, then asked."""
    x = T.read(spark, d, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("sha256"), "text")
    path, merged = shared.folder(spark), shared.folder(spark)
    even = F.pmod(F.xxhash64("sha256"), F.lit(2)) == 0
    I.add(x.filter(even), path)
    I.add(x.filter(~even), path)
    I.merge(spark, path, merged, x)
    return I.matches(spark, merged, x, ["license", "mit"]).select("sha256").distinct()


@query("""WITH w AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '/2019年/2019年03月' WHEN 1 THEN source || '/2019-03' WHEN 2 THEN source || '/deep/2019' ELSE source || '/201903_title' END AS dest, CASE WHEN doc_id % 7 <> 0 THEN '2021' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '05' END AS date FROM documents),
 n AS (SELECT *, CASE WHEN date IS NULL THEN dest WHEN doc_id % 4 = 0 THEN replace(dest, '2019年/2019年03月', '2021年/2021年' || date[5:6] || '月') WHEN doc_id % 4 = 1 THEN replace(dest, '2019-03', '2021-' || date[5:6]) WHEN doc_id % 4 = 2 THEN replace(dest, '2019', '2021') ELSE dest END AS cand FROM w),
 k AS (SELECT DISTINCT source || '/2021年' AS dir FROM documents WHERE doc_id % 3 = 0 UNION SELECT DISTINCT source || '/2021-05' FROM documents UNION SELECT DISTINCT source FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, CASE WHEN note <> '' THEN cand ELSE dest END AS adjusted, note FROM (SELECT *, CASE WHEN cand = dest THEN '' WHEN cand IN (SELECT dir FROM k) THEN 'moved' WHEN regexp_replace(cand, '/[^/]*$', '') IN (SELECT dir FROM k) THEN 'new' ELSE '' END AS note FROM n)""")
def dated_destinations(spark, d):
    t, i, s = T.read(spark, d, "documents"), F.col("doc_id"), F.col("source")
    dest = F.when(i % 4 == 0, F.concat(s, F.lit("/2019年/2019年03月"))).when(i % 4 == 1, F.concat(s, F.lit("/2019-03"))).when(i % 4 == 2, F.concat(s, F.lit("/deep/2019"))).otherwise(F.concat(s, F.lit("/201903_title")))
    date = F.when(i % 7 != 0, F.concat(F.lit("2021"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("05")))
    wanted = t.select("doc_id", F.lit("docs").alias("root"), dest.alias("dest"), date.alias("date"))
    known = t.filter(i % 3 == 0).select(F.concat(s, F.lit("/2021年")).alias("dir")).union(t.select(F.concat(s, F.lit("/2021-05")))).union(t.filter(i % 5 == 0).select(s)).distinct().withColumn("root", F.lit("docs"))
    return D.dated_destinations(wanted, known).select("doc_id", "adjusted", "note")
