"""Each stage of the pipeline on what its predecessor kept, against plain Python."""

import collections
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components
from treeledger.llm.toxicity import toxicity_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAK = [f"bench{i}" for i in range(14)]


def planted():
    rows, toxic = [], set()
    for i in range(360):
        words = [f"plain{(i * 31 + k * (1 + i % 7)) % 200}" for k in range(40 + i % 25)]
        if i % 4 == 0:
            words[7] = ["grobnix", "grobtal"][i // 4 % 2]
            toxic.add(i)
        rows.append([i, words])
    for i in range(1, 60, 4):  # near copies: one word of many changed
        words = [f"group{i // 12}w{k}" for k in range(80)]
        words[i] = f"odd{i}"
        rows[i][1] = words
    for i in range(2, 40, 8):
        rows[i][1] = rows[i][1][:20] + LEAK[:11] + rows[i][1][20:]
    out = [(i, " ".join(w), "en", ["a", "b", None][i % 3], 0) for i, w in rows]
    out += [out[3], (900, None, "en", "b", None), (901, "", "en", "a", 0), (None, "lone words here", None, "a", 0)]
    return out, toxic


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, toxic = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(360)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(LEAK)), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def plain(rows):
    return collections.Counter((r.doc_id, r.text, r.source) for r in rows)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, toxic = planted()
    kept = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf))
        kept.append(docs.collect())
        assert name == "sharding" or docs.columns == COLUMNS
    start, clean, single, free, mixed, last = kept

    # the classifier's accuracy is tested with op7; here its decisions have to take effect, on whole rows
    said = {r.doc_id: r.predicted for r in toxicity_digest(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert plain(clean) == plain(r for r in start if not said[r.doc_id])
    assert sum(said[i] for i in toxic) > len(toxic) / 2

    parts = brute_components([(r.doc_id, r.text, r.source) for r in clean])
    least = collections.defaultdict(list)
    want = collections.Counter()
    for (n, c), r in zip(parts, clean, strict=True):
        if n:
            least[c].append((r.doc_id is None, r.doc_id or 0))
        else:
            want[r.doc_id] += 1
    want.update(None if min(ids)[0] else min(ids)[1] for ids in least.values())
    assert collections.Counter(r.doc_id for r in single) == want and len(single) < len(clean)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    assert plain(free) == plain(r for r in single if not grams(words(r.text)) & grams(LEAK)) and len(free) < len(single)

    size = lambda r: len((r.text or "").split())
    per = collections.Counter()
    for r in free:
        per[r.source] += size(r)
    order = sorted((s for s in per if s is not None)) + [s for s in per if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(per.values()) - sum(3 * per[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * per[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * per[s]}
        if not over:
            break
        capped |= over
    copies = plain(mixed)
    for r in free:
        rate = target[r.source] / per[r.source]
        assert int(rate) <= copies[r.doc_id, r.text, r.source] <= int(rate) + 1
    assert set(copies) <= set(plain(free))

    assert plain(last) == copies
    assert sorted(r.shard + 16 * r.slot for r in last) == list(range(len(last)))


def test_run_and_empty_tables(spark, sf, tmp_path):
    once = corpus_pipeline.run(spark, sf).collect()
    again = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id or -1, r.shard, r.slot)
    assert sorted(map(key, once)) == sorted(map(key, again)) and once
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
