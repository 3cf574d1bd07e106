import html
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.functions.rules import replacer
from cadenza.operators import script as N

SCHEMA = "doc_id long, pos int, type string, level int, speaker string, text string"
BLOCKS = [
    (1, 0, "heading", 1, None, "Title"),
    (1, 1, "quote", None, "Ann", "First"),
    (1, 2, "embed", None, None, "ignored"),
    (1, 3, "quote", None, None, "Nobody said"),
    (1, 4, "quote", None, "Bo", " "),
    (1, 5, "quote", None, "Bo", "Second"),
    (1, 6, "paragraph", None, "stray", "Text"),
    (1, 7, "list", None, None, "One. Two"),
    (1, 8, "quote", None, "Cy", "Third"),
    (1, 9, "quote", None, "Di", "Fourth"),
    (1, 10, "quote", None, "Ed", "Fifth"),
    (2, 0, "quote", None, "Fay", "Alone"),
    (3, 0, "paragraph", None, None, None),
    (3, 1, None, None, None, "no type"),
]


def rows(df):
    return [tuple(r) for r in df.orderBy("doc_id", "block_index").collect()]


def test_script_keeps_order_and_leads_in_attributed_quotes(spark):
    got = rows(N.build_script(spark.createDataFrame(BLOCKS, SCHEMA)))
    assert got == [
        (1, 0, "heading", "Title", None),
        (1, 1, "quote", 'Ann says, "First"', "Ann"),
        (1, 2, "quote", "Nobody said", None),
        (1, 3, "quote", 'Bo shares, "Second"', "Bo"),
        (1, 4, "paragraph", "Text", None),
        (1, 5, "list", "One. Two", None),
        (1, 6, "quote", 'Cy reflects, "Third"', "Cy"),
        (1, 7, "quote", 'Di feels, "Fourth"', "Di"),
        (1, 8, "quote", 'Ed says, "Fifth"', "Ed"),
        (2, 0, "quote", 'Fay says, "Alone"', "Fay"),
    ]


def test_two_voice_equals_preserve_and_exclude_drops_quotes(spark):
    blocks = spark.createDataFrame(BLOCKS, SCHEMA)
    assert rows(N.build_script(blocks, "two_voice")) == rows(N.build_script(blocks))
    out = N.build_script(blocks, "exclude")
    assert [r[3] for r in rows(out)] == ["Title", "Text", "One. Two"]
    assert {r.doc_id for r in N.documents_without_script(blocks, out).collect()} == {2, 3}


@pytest.mark.parametrize("mode", ["", "Preserve", "both", None])
def test_unknown_modes_are_errors(spark, mode):
    with pytest.raises(ValueError):
        N.apply_quote_mode(spark.createDataFrame(BLOCKS, SCHEMA), mode)


def test_counts(spark):
    blocks = spark.createDataFrame(BLOCKS, SCHEMA)
    got = {r.doc_id: (r.extracted, r.kept, r.quotes) for r in N.script_counts(blocks, N.build_script(blocks)).collect()}
    assert got == {1: (11, 9, 6), 2: (1, 1, 1), 3: (2, 0, 0)}


def one_after_the_other(text, rules):
    for written, spoken in sorted(rules, key=lambda r: len(r[0]), reverse=True):
        text = re.sub(rf"(?<!\w){re.escape(written)}(?!\w)", lambda _: spoken, text)
    return text


WORDS = st.text(alphabet="ab c.é", min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), max_size=12), st.lists(st.text(alphabet="ab c.é_", max_size=40), max_size=4))
def test_rules_equal_their_definition(rules, texts):
    """Rules feed each other, repeat and overlap."""
    apply = replacer(tuple(sorted(rules, key=lambda r: len(r[0]), reverse=True)))
    assert [apply(t) for t in texts] == [one_after_the_other(t, rules) for t in texts]


def test_ten_thousand_rules(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    rules = list({w: " ".join(word() for _ in range(rng.randrange(1, 3))) for w in (word() + rng.choice(["", f" {word()}"]) for _ in range(20_000))}.items())[:10_000]
    texts = [" ".join(word() for _ in range(30)) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = spark.createDataFrame(rules, "written string, spoken string").repartition(3)
    got = {r.i: r.text for r in N.apply_pronunciation(df, table).collect()}
    assert len(rules) == 10_000 and got == {i: one_after_the_other(t, sorted(rules)) for i, t in enumerate(texts)}


def test_pronunciation_is_whole_word_longest_first_and_literal(spark):
    text = spark.createDataFrame([("AI AI (AI), AIs, étudeAI; AI lab $x",)], "text string")
    got = N.apply_pronunciation(text, [("AI", "A.I."), ("AI lab", "ay eye $1 \\lab"), ("$x", "dollar")]).first()[0]
    assert got == "A.I. A.I. (A.I.), AIs, étudeAI; ay eye $1 \\lab dollar"
    for bad in (("", "x"), ("x", "")):
        with pytest.raises(ValueError):
            N.apply_pronunciation(text, [bad])


def test_empty_tables(spark):
    blocks = spark.createDataFrame([], SCHEMA)
    assert N.build_script(blocks).count() == 0
    assert N.script_counts(blocks, N.build_script(blocks)).count() == 0
    assert N.keep_speakable(blocks).select(F.col("speaker")).count() == 0


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.sampled_from(["&", "&amp", "&amp;", "&apos;", "&#146;", "&ampx", "&notit;", "&NotEqualTilde;", "&#x1F600;", "&#0;", "&#x110000;", "&#00000000065;", "&#99999999999;", "&#xD800;", "&#11;", "&#xFDD0;", "&#;", "&#x;", "&nosuch;", "&fjlig;", "&CounterClockwiseContourIntegral;", "&frac12x", ";", "#"]), st.text("amp&#x;19 ", max_size=6)), max_size=5).map("".join), min_size=1, max_size=8))
def test_references_are_read_as_the_standard_library_reads_them(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for r in df.select("i", T.decode_entities(F.col("t")).alias("got")).collect():
        assert r.got == html.unescape(texts[r.i]), texts[r.i]


def test_canonical_json_sorts_keys_and_refuses_what_json_lacks(spark):
    row = [({"z": 1, "a": None}, ("é", [(2, 1.5)], None))]
    df = spark.createDataFrame(row, "m map<string,int>, s struct<y: string, l: array<struct<k: int, a: double>>, b: struct<q: int>>").select(F.struct("s", "m").alias("v"))
    got = df.select(T.canonical_json(F.col("v"), df.schema["v"].dataType)).first()[0]
    assert got == '{"m":{"a":null,"z":1},"s":{"b":null,"l":[{"a":1.5,"k":2}],"y":"é"}}'
    for bad in ("nan", "inf", "-inf"):
        odd = spark.createDataFrame([(float(bad),)], "x double").select(F.struct("x").alias("v"))
        with pytest.raises(PySparkException):
            odd.select(T.canonical_json(F.col("v"), odd.schema["v"].dataType)).collect()
