"""The stored trigram index: deltas, merging, and which partitions a question reads."""

import contextlib
import io
import re

from treeledger.operators import postings as I
from treeledger.operators import search as S

TEXTS = [("a", "The license of ACME"), ("b", "licence fees"), ("c", "acme LICENSE text"), ("d", None), ("e", "Ｌicense in wide letters"), ("f", "xy")]


def test_deltas_and_merging(spark, tmp_path):
    frame = spark.createDataFrame(TEXTS, "sha256 string, text string")
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    I.add(frame.filter("sha256 < 'c'"), first, 16)
    I.add(frame.filter("sha256 >= 'c'"), first, 16)
    I.add(frame.filter("sha256 = 'a'"), first, 16)
    for terms in (["license"], ["acme", "lic"], ["xy"], ["nothing here"], ["of", "license"]):
        want = sorted(r.sha256 for r in S.text_matches(frame, terms).collect())
        assert sorted(r.sha256 for r in I.matches(spark, first, frame, terms, 16).collect()) == want
    left = frame.filter("sha256 <> 'c'")
    I.merge(spark, first, second, left, 16)
    assert sorted(r.sha256 for r in I.matches(spark, second, left, ["license"], 16).collect()) == ["a", "e"]
    assert spark.read.parquet(second).count() == spark.read.parquet(second).select("trigram", "sha256").distinct().count() < spark.read.parquet(first).count()


def test_only_the_buckets_of_a_question_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    I.add(spark.createDataFrame([(f"s{i}", f"word{i * 7919} and {i * 104729}") for i in range(200)], "sha256 string, text string"), path, 64)
    every = {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(path).inputFiles()}
    asked = I.postings(spark, path, ["and"], 64)
    with contextlib.redirect_stdout(io.StringIO()) as said:
        asked.explain("formatted")
    assert len(every) > 30 and asked.count() == 200
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", said.getvalue()) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(trigram,and\)", said.getvalue())
