"""Search strings against a plain evaluator, and metadata taken off and put back."""

import re
from datetime import UTC, datetime, timedelta
from urllib.parse import parse_qsl

import pytest

from treeledger.operators import attach as A
from treeledger.operators import dictionary as D
from treeledger.operators import fold as G
from treeledger.operators import saved as S

DAY = 86_400 * 10**9
ENTRIES = [
    # relpath, is_dir, size, day, sha, gone_at
    ("", True, 0, 1, None, None), ("work", True, 0, 1, None, None), ("work/Report 1.pdf", False, 10, 3, "a", None), ("work/report 2.txt", False, 20, 5, "b", None),
    ("work/in/pic.jpg", False, 30, 7, "c", None), ("home", True, 0, 1, None, None), ("home/copy.pdf", False, 10, 9, "a", None), ("home/100%_x.txt", False, 5, 11, "d", None),
    ("home/old.txt", False, 6, 2, "e", 50), ("home/old.txt", False, 9, 4, "e", 70), ("home/back.txt", False, 7, 6, "f", None), ("home/back.txt", False, 8, 6, "f", 60), ("nohash.txt", False, 1, 12, None, None),
]
TAGS = [("work", "job"), ("work/report 2.txt", "paid"), ("home", "private"), ("home/copy.pdf", "paid"), ("work/in", "deep"), ("work/in", "job")]
VALUES = [("", "state", "open"), ("work", "amount", "1000"), ("work/report 2.txt", "amount", "250.5"), ("home", "due", "2026-03-05"), ("home/copy.pdf", "note", "Called ACME ltd"), ("work", "amount2", "x")]
KINDS = {"state": "choice", "amount": "number", "due": "date", "note": "text", "amount2": "number"}
ALIASES = {"payed": "paid"}
TEXTS = {"a": "Invoice for ACME", "b": "meeting notes acme", "d": "nothing", "e": "acme old"}

STRINGS = [
    "q=report", "q=REPORT+1", "q=100%25_", "kind=pdf", "kind=document&under=home", "under=work", "under=work&folders=1", "tag=job", "tag=job&tag=paid", "tag=job&tag=paid&mode=or", "tag=payed", "not=job&q=.",
    "untagged=1&folders=1", "tag=paid&direct=1", "tag=job&direct=1&folders=1", "untagged=1&direct=1", "attr=amount", "attr=amount%3E300", "attr=amount%3C%3D1,000&under=work", "attr=state%3Dopen&kind=pdf", "attr=due%3E2026-03-01",
    "attr=note%3Dacme", "attr=amount2%3D1", "attr=nowhere%3D1", "attr=amount&attr=state%3Dopen&tag=paid", "after=1970-01-05&before=1970-01-08", "min_size=10&max_size=20", "text=acme", "text=acme+notes", "text=acme&gone=1", "under=home&gone=1",
    "max_size=8&gone=1", "kind=pdf&collapse=1", "q=.&collapse=1&gone=1", "q=.&limit=2",
]


def plain(query):
    f = parse_qsl(query, keep_blank_values=True)
    one = lambda k, d="": next((v for n, v in f if n == k), d)
    every = lambda k: [v for n, v in f if n == k]
    ancestors = lambda p: [p] + [p.rsplit("/", i)[0] for i in range(1, p.count("/") + 1)] + ([""] if p else [])
    tags_of = lambda p: {t for q, t in TAGS if q == p or (one("direct") != "1" and q in ancestors(p))}
    ends = {"pdf": {"pdf"}, "document": {"pdf", "txt"}}

    def value(p, name):
        return next((v for q in ancestors(p) for r, n, v in VALUES if r == q and n == name), None)

    def meets(p, raw):
        m = re.match(r"^(.+?)(>=|<=|=|>|<)(.*)$", raw)
        name, op, want = (m[1], m[2], m[3]) if m else (raw, "", "")
        v, kind = value(p, name), KINDS.get(name)
        if not op:
            return v is not None
        if v is None or kind is None:
            return False
        if kind == "number":
            try:
                v, want = float(v), float(want.replace(",", ""))
            except ValueError:
                return False
        elif kind == "text":
            return op == "=" and want.casefold() in v.casefold()
        elif kind != "date":
            return op == "=" and v == want
        return {"=": v == want, ">=": v >= want, "<=": v <= want, ">": v > want, "<": v < want}[op]

    out = []
    for p, is_dir, size, day, sha, gone in ENTRIES:
        ok = one("gone") == "1" or gone is None
        ok &= all(w.lower() in p.lower() for w in one("q").split())
        ok &= not (is_dir and (one("folders") != "1" or one("kind") or one("min_size") or one("max_size")))
        ok &= not one("kind") or p.rsplit(".", 1)[-1] in ends[one("kind")]
        ok &= not one("under") or p == one("under") or p.startswith(one("under") + "/")
        ok &= not one("min_size") or size >= int(one("min_size"))
        ok &= not one("max_size") or size <= int(one("max_size"))
        when = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(days=day)
        ok &= not one("after") or when.strftime("%Y-%m-%d") >= one("after")
        ok &= not one("before") or when.strftime("%Y-%m-%d") <= one("before")
        ok &= all(w.lower() in TEXTS.get(sha, "").lower() and sha in TEXTS for w in one("text").split())
        if ok:
            out.append((p, is_dir, sha, gone))
    if one("gone") == "1":
        best = {}
        for row in out:
            if row[0] not in best or row[3] is None or (best[row[0]][3] is not None and row[3] > best[row[0]][3]):
                best[row[0]] = row
        out = list(best.values())
    want = [ALIASES.get(t, t) for t in every("tag")]
    out = [r for r in out if not want or (any if one("mode") == "or" else all)(t in tags_of(r[0]) for t in want)]
    out = [r for r in out if not any(t in tags_of(r[0]) for t in every("not")) and (one("untagged") != "1" or not tags_of(r[0])) and all(meets(r[0], c) for c in every("attr"))]
    out.sort(key=lambda r: r[0])
    if one("collapse") == "1":
        seen = set()
        out = [r for r in out if r[3] is not None or r[2] is None or not (r[2] in seen or seen.add(r[2]))]
    return [(p, g) for p, _, _, g in out][: int(one("limit", "500"))]


def test_strings_against_a_plain_evaluator(spark):
    entries = spark.createDataFrame([("r", p, d, s, day * DAY, h, g) for p, d, s, day, h, g in ENTRIES], "root string, relpath string, is_dir boolean, size long, mtime_ns long, sha256 string, gone_at long").cache()
    tags = spark.createDataFrame([("r", *t) for t in TAGS], "root string, path string, tag string").cache()
    values = spark.createDataFrame([("r", *v) for v in VALUES], "root string, path string, name string, value string").cache()
    names = D.canonical_names(spark.createDataFrame(list(ALIASES.items()), "alias string, tag string"))
    extracts = spark.createDataFrame(list(TEXTS.items()), "sha256 string, text string")
    for query in STRINGS:
        got = [(r.relpath, r.gone_at) for r in S.search(query, entries, tags, values, KINDS, names, extracts).collect()]
        assert got == plain(query), query


def test_parsing():
    a = S.parse("attr=state&attr=amount>=5&tag=x&limit=9000&mode=or&before=2026-01-01&min_size=1e3")
    assert a.attributes == (("state", "exists", ""), ("amount", ">=", "5")) and a.include == ("x",) and a.limit == 5000 and a.any_tag and a.min_size == 1000
    assert a.before_ns == int(datetime(2026, 1, 2, tzinfo=UTC).timestamp()) * 10**9
    assert S.condition(" a  b <= 3 ") == ("a b", "<=", "3") and S.condition("=x") == ("=x", "exists", "")
    for bad in ("", "limit=5", "kind=nothing", "q=+", "after=yesterday", "min_size=x&q=a"):
        with pytest.raises(ValueError):
            S.parse(bad)


def test_detach_and_attach(spark):
    log = [
        {"op": "add", "path": "d/f", "tag": "t"}, {"op": "add", "path": "d/f", "tag": "was"}, {"op": "add", "path": "keep", "tag": "t"}, {"op": "attr-set", "path": "d", "name": "n", "value": "1"}, {"op": "attr-set", "path": "d/f", "name": "lost", "value": "2"},
        {"op": "relate", "src": "keep", "dst": "d/f", "kind": "k"}, {"op": "relate", "src": "keep", "dst": "far", "kind": "k"}, {"op": "dir-type", "path": "d", "type": "inbox"}, {"op": "dir-card", "path": "d/g", "description": "text", "naming": ""},
    ]
    frame = lambda rows: spark.createDataFrame([tuple(({"root": "r", "seq": i} | e).get(c) for c in G.COLUMNS) for i, e in enumerate(rows)], ", ".join(f"{c} {t}" for c, t in G.COLUMNS.items()))
    tables = ["items", "attrs", "relations", "types", "cards"]
    state = G.fold(frame(log), tables)
    record = A.detached(state, spark.createDataFrame([("r", "d"), ("q", "d")], "root string, base string"))
    rows = [r.asDict() for r in record.collect()]
    assert sorted(r["fact"] for r in rows) == ["attr", "attr", "card", "item", "item", "relation", "type"] and {r["base"] for r in rows} == {"d"}
    record = spark.createDataFrame(rows, record.schema)
    off = [{k: v for k, v in r.asDict().items() if v is not None} for r in A.detach_events(record).collect()]
    bare = G.fold(frame(log + off), tables)
    left = {t: sorted(tuple(r) for r in bare[t].collect()) for t in tables}
    assert left == {"items": [("r", "keep", "t")], "attrs": [], "relations": [("r", "keep", "far", "k")], "types": [], "cards": []}
    again = bare | {"attrs": bare["attrs"], "types": spark.createDataFrame([("r", "d", "archive")], "root string, path string, type string")}
    names = spark.createDataFrame([("was", "now")], "alias string, tag string")
    on = [{k: v for k, v in r.asDict().items() if v is not None} for r in A.attach_events(record, again, names, spark.createDataFrame([("n",)], "name string")).collect()]
    back = G.fold(frame(log + off + on), ["items", "attrs", "relations", "types", "cards"])
    got = {t: sorted(tuple(r) for r in back[t].collect()) for t in tables}
    assert got["items"] == [("r", "d/f", "now"), ("r", "d/f", "t"), ("r", "keep", "t")] and got["attrs"] == [("r", "d", "n", "1")]
    assert got["relations"] == [("r", "keep", "d/f", "k"), ("r", "keep", "far", "k")] and got["types"] == [("r", "d", "inbox")] and got["cards"] == [("r", "d/g", "text", "")]
