"""Licence scans with a positional rare-token index, in DataFrame functions only.

One pass counts in how many documents each word of the licence templates stands
(at most one row per template word comes back to the driver). In every template
the mandatory key phrase is indexed by its two words of highest IDF. A file that may
hold one of the rarer ones gets postings, the places of these words; the postings of a
template's two words, each moved back by the word's place in the phrase, are
intersected, and at what is left the whole key phrase is verified word by word.
The other words of the template, looked up at their relative positions too, give the
score: the IDF-weighted share of the template that is in place, best over all places.
The key phrases of the base labels are templates' key phrases, so no base place
is missed, however rare or common its words are in the corpus.

Everything after the counting is a projection of the row: nothing is shuffled.

Defined results: null text is empty; no place gives n_base 0, null first_word
and last_word, empty labels and score 0; rows that repeat a doc_id stay rows of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: Label, template, key phrase. The first four are the base.
TEMPLATES = (
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("mit", "released under the mit license", "mit license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
)
BASE = 4
#: What separates words, before letters are put in lower case.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _key(template: str, phrase: str) -> tuple[list[str], int, int]:
    words, key = template.split(), phrase.split()
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return words, at, len(key)


def word_idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """IDF of every template word over all documents."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    # lower() also changes letters outside A-Z, but turns none into a letter that the templates hold
    words = F.split(F.lower(text_col), BREAK)
    rows = (
        docs.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(F.array_intersect(words, F.array(*map(F.lit, vocabulary))), F.array().cast("array<string>")))).alias("w"))
        .groupBy("w").count().collect()
    )  # fmt: skip  at most a row for each template word, and "" for the number of documents
    df = {r["w"]: r["count"] for r in rows}
    return {w: round(math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1, 6) for w in vocabulary}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and, for each label, its places."""
    idf = word_idf(docs, text_col)
    parts = []
    for label, template, phrase in TEMPLATES:
        words, at, n = _key(template, phrase)
        rare = sorted(range(n), key=lambda j: (-idf[words[at + j]], j))[:2]
        parts.append((label, words, at, n, rare))
    seldom = sorted({words[at + rare[0]] for _, words, at, _, rare in parts})
    posted = sorted({words[at + j] for _, words, at, _, rare in parts for j in rare})

    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.split(text, BREAK)
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        # of the pieces, the first and the last one may be empty
        (F.size(raw) - (F.get(raw, F.lit(0)) == "").cast("int") - ((F.size(raw) > 1) & (F.element_at(raw, -1) == "")).cast("int")).cast("long").alias("n_words"),
        F.when(text.rlike(rf"(?i)(?:{'|'.join(seldom)})(?:{BREAK[:-1]}|\z)"), F.filter(F.split(F.lower(text), BREAK), lambda x: x != "")).otherwise(F.array().cast("array<string>")).alias("_w"),
    )
    w = lambda i: F.get(F.col("_w"), i)
    postings = F.filter(F.transform("_w", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda z: z["w"].isin(*posted))
    found = split.withColumn("_post", postings)

    def places(words: list[str], at: int, n: int, rare: list[int]) -> Column:
        """Starts of the key phrase: where the postings of its rare words agree and the other words are in place."""
        starts = lambda j: F.transform(F.filter("_post", lambda z: z["w"] == words[at + j]), lambda z: z["i"] - j)
        agreed = F.array_intersect(*map(starts, rare))

        def whole(s: Column) -> Column:
            ok = F.lit(True)
            for j in sorted(set(range(n)) - set(rare)):
                ok = ok & F.coalesce(w(s + j) == words[at + j], F.lit(False))
            return ok

        return F.filter(agreed, whole)

    found = found.withColumns({f"_p{k}": places(words, at, n, rare) for k, (_, words, at, n, rare) in enumerate(parts)})

    def share(k: int) -> Column:
        _, words, at, _, _ = parts[k]
        total = sum(idf[x] for x in words)

        def of(s: Column) -> Column:
            got = F.lit(0.0)
            for j, x in enumerate(words):
                got = got + F.when(w(s + (j - at)) == x, F.lit(idf[x])).otherwise(0.0)
            return got / total

        return F.coalesce(F.array_max(F.transform(f"_p{k}", of)), F.lit(0.0))

    base = F.concat(*[f"_p{k}" for k in range(BASE)])
    named = lambda ks: F.array_join(F.sort_array(F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(parts[k][0])) for k in ks]), lambda x: x.isNotNull())), ",")
    return found.withColumn("_base", base).select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"),
        F.array_max("_base").cast("long").alias("last_word"),
        named(range(BASE)).alias("base_labels"),
        named(range(len(parts))).alias("labels"),
        F.round(F.greatest(*[share(k) for k in range(len(parts))]), 6).alias("score"),
        F.map_filter(F.create_map(*[x for k, p in enumerate(parts) for x in (F.lit(p[0]), F.col(f"_p{k}"))]), lambda _, v: F.size(v) > 0).alias("places"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.documents(spark, sf_dir)).drop("places")


def _sql() -> str:
    vocabulary = sorted({x for _, t, _ in TEMPLATES for x in t.split()})
    listed = ", ".join(f"'{x}'" for x in vocabulary)
    cols, shares = [], []
    for k, (_, template, phrase) in enumerate(TEMPLATES):
        words, at, n = _key(template, phrase)
        key = " AND ".join(f"w[i + {j}] = '{words[at + j]}'" for j in range(n))
        cols.append(f"list_filter(range(1, len(w) - {n - 2}), lambda i: {key}) AS p{k}")
        got = " + ".join(f"CASE WHEN s + {j - at} >= 1 AND w[greatest(s + {j - at}, 1)] = '{x}' THEN m['{x}'] ELSE 0 END" for j, x in enumerate(words))
        total = " + ".join(f"m['{x}']" for x in words)
        shares.append(f"coalesce(list_max(list_transform(p{k}, lambda s: ({got}) / ({total}))), 0)")
    labels = lambda ks: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{TEMPLATES[k][0]}' END" for k in ks) + "], lambda x: x IS NOT NULL)), ',')"
    base = "list_concat(list_concat(p0, p1), list_concat(p2, p3))"
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
v AS (SELECT unnest([{listed}]) AS x),
d AS (SELECT x, count(*) AS df FROM (SELECT unnest(list_distinct(list_filter(w, lambda x: x IN ({listed})))) AS x FROM t) GROUP BY x),
i AS (SELECT x, round(ln(((SELECT count(*) FROM t) + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1, 6) AS idf FROM v LEFT JOIN d USING (x)),
m AS (SELECT map(list(x), list(idf)) AS m FROM i),
p AS (SELECT doc_id, w, {', '.join(cols)} FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, len({base})::BIGINT AS n_base, (list_min({base}) - 1)::BIGINT AS first_word, (list_max({base}) - 1)::BIGINT AS last_word,
       {labels(range(BASE))} AS base_labels, {labels(range(len(TEMPLATES)))} AS labels, round(greatest({', '.join(shares)})::DOUBLE, 6) AS score
FROM p, m
"""


SQL = _sql()
