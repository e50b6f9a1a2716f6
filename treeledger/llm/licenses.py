"""License scans by a positional index of rare words.

Every template has a mandatory key phrase. The inverse document frequencies of
the templates' words over all texts pick the two rarest words of each key
phrase as its anchors; an index maps a first anchor to its postings (template,
position). A text's words look themselves up, each posting proposes where the
template would start, proposals whose second anchor does not stand at its
relative position fall away, and for the rest the key phrase is verified word
by word and the template's coverage is the weight of its words that stand in
place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

# The base phrases and their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# (label, template, key phrase): further licences; the key phrase stands inside the template.
MORE = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "bsd license", "bsd license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("lgpl", "lesser general public license", "lesser general public license"),
    ("agpl", "affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("isc", "isc license", "isc license"),
    ("zlib", "zlib license", "zlib license"),
    ("bsl", "boost software license", "boost software license"),
    ("artistic", "artistic license", "artistic license"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]
_GNU = (
    "this {what} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation"
    " either version {version} of the license or at your option any later version this {what} is distributed in the hope that it will be useful but without any"
    " warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details"
)


def _gnu(label: str, what: str, name: str, version: str) -> tuple[str, str, str]:
    return label, _GNU.format(what=what, name=name, version=version), f"gnu {name} as published by the free software foundation either version {version} of the license"


# Notices and bodies of licences, as their words stand in files.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions of source code must retain the above copyright notice"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "unless required by applicable law or agreed to in writing software distributed under the license"),
    _gnu("gpl-2.0", "program", "general public license", "2"),
    _gnu("gpl-3.0", "program", "general public license", "3"),
    _gnu("agpl-3.0", "program", "affero general public license", "3"),
    _gnu("lgpl-2.1", "library", "lesser general public license", "2 1"),
    _gnu("lgpl-3.0", "library", "lesser general public license", "3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "under the terms of the eclipse public license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", "to use reproduce display distribute execute and transmit the software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
]
COVERAGE = 0.8


def catalog() -> list[dict]:
    rows = [(label, t, t, True) for label, t in BASE] + [(*r, False) for r in MORE + NOTICES]
    out = []
    for label, template, key, base in rows:
        words, key_words = template.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key_words)] == key_words)
        out.append({"label": label, "words": words, "key": key_words, "at": at, "base": base})
    return out


def vocabulary() -> list[str]:
    return sorted({w for t in catalog() for w in t["words"]})


def idf(docs: DataFrame) -> dict[str, float]:
    """ln((N + 1) / (df + 1)) + 1 of the templates' words over all texts; a result of as many rows as the vocabulary has words."""
    known = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary())))
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}
    n = found.get("", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary()}


def _lit_array(values, kind: str):
    return F.split(F.lit(" ".join(str(v) for v in values)), " ").cast(f"array<{kind}>")  # words and numbers hold no spaces


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__n_words`` and ``__found``, an array of (template, start of its key phrase, coverage).

    Row by row, without a shuffle: null and empty texts have no words and find
    nothing, an empty table gives an empty one; repeated rows get the same
    answer; very long texts are scanned whole; no other column is looked at
    (those named ``__words``, ``__spots``, ``__proposed``, ``__n_words`` and
    ``__found`` are replaced). Templates with equal coverage are all found.
    """
    weights = idf(docs)
    templates, postings = [], {}
    for i, t in enumerate(catalog()):
        by_rarity = sorted(dict.fromkeys(t["key"]), key=lambda w: (-weights[w], w))
        first, second = by_rarity[0], by_rarity[min(1, len(by_rarity) - 1)]
        postings.setdefault(first, []).append((i, t["at"] + t["key"].index(first)))
        templates.append(
            F.struct(
                _lit_array(t["words"], "string").alias("w"),
                _lit_array([weights[w] for w in t["words"]], "double").alias("x"),
                _lit_array(t["key"], "string").alias("k"),
                F.lit(t["at"]).alias("at"),
                F.lit(second).alias("a2"),
                F.lit(t["at"] + t["key"].index(second)).alias("p2"),
                F.lit(sum(weights[w] for w in t["words"])).alias("total"),
            )
        )
    index = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(p).alias("p")) for i, p in ps]))])
    table, words = F.array(*templates), F.col("__words")
    spots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(postings)), i)), lambda i: i.isNotNull())
    proposed = F.flatten(F.transform("__spots", lambda i: F.transform(F.try_element_at(index, F.get(words, i)), lambda q: F.struct(q["t"].alias("t"), (i - q["p"]).alias("s")))))

    def stands(c):
        t = F.get(table, c["t"])
        start = c["s"] + t["at"]
        return (start >= 0) & (F.get(words, c["s"] + t["p2"]) == t["a2"]) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(t["k"])) == t["k"])

    def covered(c):
        t = F.get(table, c["t"])
        sum_ = F.aggregate(F.sequence(F.lit(0), F.size(t["w"]) - 1), F.lit(0.0), lambda acc, j: acc + F.when((c["s"] + j >= 0) & (F.get(words, c["s"] + j) == F.get(t["w"], j)), F.get(t["x"], j)).otherwise(0.0))
        return F.struct(c["t"].alias("t"), (c["s"] + t["at"]).alias("start"), F.round(sum_ / t["total"], 6).alias("coverage"))

    held = docs.withColumn("__words", words_of(F.col("text"))).withColumn("__spots", spots)
    found = F.filter(F.transform(F.filter("__proposed", stands), covered), lambda c: c["coverage"] >= COVERAGE)
    held = held.withColumn("__n_words", F.size("__words").cast("long")).withColumn("__proposed", proposed).withColumn("__found", found)
    return held.drop("__words", "__spots", "__proposed")


def licenses_digest(docs: DataFrame) -> DataFrame:
    """op1: words, base places with the first and last start, base labels, all labels, and the best coverage (0 without a match)."""
    labels, n_base = _lit_array([t["label"] for t in catalog()], "string"), len(BASE)
    base = F.filter("__found", lambda c: c["t"] < n_base)
    starts = F.transform("__base", lambda c: c["start"].cast("long"))
    names = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda c: F.get(labels, c["t"])))), ",")
    return (
        scan(docs.select("doc_id", "text"))
        .withColumn("__base", base)
        .select(
            "doc_id",
            F.col("__n_words").alias("n_words"),
            F.size("__base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            names("__base").alias("base_labels"),
            names("__found").alias("labels"),
            F.coalesce(F.array_max(F.transform("__found", lambda c: c["coverage"])), F.lit(0.0)).alias("score"),
        )
    )


def licenses_sql() -> str:
    """The same in DuckDB's SQL, by joining words instead of looking them up."""
    ts = catalog()
    rows = ", ".join(f"({i}, '{t['label']}', {str(t['base']).lower()}, {t['at']}, {t['words']!r}, {t['key']!r})" for i, t in enumerate(ts))
    return rf"""
WITH tpl(t, label, base, off, words, keys) AS (VALUES {rows}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
tw AS (SELECT t, unnest(words) AS word, unnest(range(len(words))) AS j FROM tpl),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM tw) GROUP BY word),
x AS (SELECT tw.t, tw.j, tw.word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df.n, 0) + 1)) + 1 AS weight FROM tw LEFT JOIN df ON tw.word = df.word),
tot AS (SELECT t, sum(weight) AS total FROM x GROUP BY t),
c AS (SELECT doc_id, w, t, off, p FROM (SELECT d.doc_id, d.w, tpl.t, tpl.off, tpl.keys, unnest(range(1, len(d.w) - len(tpl.keys) + 2)) AS p FROM d, tpl WHERE list_contains(d.w, tpl.keys[1]) AND len(d.w) >= len(tpl.keys)) q WHERE w[p] = keys[1] AND w[p:p + len(keys) - 1] = keys),
m AS (SELECT c.doc_id, c.t, c.p - 1 AS start, round(coalesce(sum(x.weight) FILTER (c.p - c.off + x.j >= 1 AND c.w[c.p - c.off + x.j] = x.word), 0) / any_value(tot.total), 6) AS coverage
  FROM c JOIN x ON c.t = x.t JOIN tot ON c.t = tot.t GROUP BY c.doc_id, c.t, c.p),
f AS (SELECT m.*, tpl.label, tpl.base FROM m JOIN tpl ON m.t = tpl.t WHERE coverage >= {COVERAGE}),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(coverage) AS score FROM f GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM f WHERE base) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n_base, 0)::BIGINT AS n_base, g.first_word::BIGINT AS first_word, g.last_word::BIGINT AS last_word, coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels, coalesce(g.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)
"""
