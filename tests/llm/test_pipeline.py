import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from cadenza.llm import bpe, common, language_id, mixing, queries
from tests.llm.test_dedup import brute_lines, brute_near

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    from tests.test_queries import TABLES, plain

    duck = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        duck.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got, want = queries.QUERIES[name](spark, SF), duck.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns) and plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.train(docs)
    kept, found = {}, {}
    for i, r in rows.items():
        names, scores = language_id.score_texts([r.text], *model)
        if names[0] != "und" and scores[0] >= 0.5:
            kept[i], found[i] = r.text, names[0]
    lines = brute_lines(kept)
    kept = {i: t for i, t in lines.items() if t == kept[i] or re.search(r"\S", t)}
    near = brute_near(kept, 5)
    kept = {i: t for i, t in kept.items() if near[i][1] == i}
    cells, tokens = {}, {}
    for i, t in kept.items():
        topic = next((n for n, p in mixing.TOPICS if re.search(p, t)), "prose")
        cells[i] = tuple(x if x in mixing.TARGETS[m] else "*" for m, x in zip(mixing.MARGINALS, (rows[i].source, rows[i].lang or found[i], topic)))
        tokens[cells[i]] = tokens.get(cells[i], 0.0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    p = mixing.keep_probabilities(tokens, mixing.rake(tokens, mixing.TARGETS))
    u = {r.doc_id: r.u for r in docs.select("doc_id", common.unit_hash(F.lit(0), F.col("doc_id")).alias("u")).collect()}
    tokenizer = Tokenizer.from_file(bpe.default_path())
    want = {i: tokenizer.encode(t).ids for i, t in kept.items() if u[i] < p[cells[i]]}
    got = P.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r.lang == (rows[r.doc_id].lang or found[r.doc_id]) for r in got)


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    for k, start in enumerate((odd, none)):
        docs = start
        for at, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, SF)
            if at < len(P.STAGES) - 1:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{k}-{at}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        if k == 0:
            assert "n_tokens" in out.columns and {"doc_id", "lang", "source", "ids", "round_trip"} < set(out.columns)


def test_near_dedup_keeps_texts_of_one_id_apart(spark):
    a, b = ("long text of " + " ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (9, b + " more", "en", "s", 1), (5, a, "en", "s", 1), (None, a, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("text_hash", F.lit(1))
    got = P.dedup_near(spark, df, SF)
    assert got.columns == df.columns and sorted((repr(r.doc_id), r.text) for r in got.collect()) == sorted([("5", a), ("5", b), ("None", a)])
