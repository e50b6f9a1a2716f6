"""Catalog queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import treeledger.catalog_queries  # noqa: F401  registers its queries
from treeledger.operators import search as S
from treeledger.queries import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")
NAMES = ["folder_moves", "search_with_gone", "item_details", "closed_folders", "closed_only_contents", "structure_chains", "snapshot_versions", "protected_folders", "cloud_items", "cleaned_names", "json_answers", "inbox_files", "tags_folded_with_moves"]


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_the_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, str(SF))
    got = con.execute(SQL[name])
    columns = [c[0] for c in got.description]
    want = [dict(zip(columns, row, strict=True)) for row in got.fetchall()]
    key = lambda row: [(row[c] is None, str(row[c])) for c in sorted(columns)]
    rows = [r.asDict() for r in df.collect()]
    assert sorted(df.columns) == sorted(columns) and rows
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_similar_by_brute_force(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(1)
    docs = [(i, " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    asked = [(100 + i, docs[3 * i][1] + " zz") for i in range(9)]

    def pairs(text):
        return Counter(g for w in text.split() for g in ([w[i : i + 2] for i in range(len(w) - 1)] or [w]))

    counts = {i: pairs(t) for i, t in docs}
    df = Counter(g for c in counts.values() for g in c)
    idf = {g: math.log(1 + len(docs) / n) for g, n in df.items()}

    def unit(c):
        w = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()} if norm else {}

    want = []
    for q, text in asked:
        u = unit(pairs(text))
        scored = [(-round(sum(x * unit(c).get(g, 0) for g, x in u.items()), 9), i) for i, c in counts.items()]
        want += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:3])]
    got = S.similar(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "id long, text string"), 3, block=4).collect()
    assert sorted((r.query_id, r.id, round(r.score, 6), r.rank) for r in got) == sorted((q, i, round(s, 6), r) for q, i, s, r in want)
