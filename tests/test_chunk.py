import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cadenza.functions import counted, text as T
from cadenza.operators import chunk as C

SCHEMA = "doc_id long, block_index int, block_type string, text string, speaker string"


def chars4(x):
    return max(1, (len(x) + 3) // 4)


def test_order_budget_metadata_and_reassembly(spark):
    script = spark.createDataFrame(
        [(1, 0, "paragraph", "One two. Three four five. Six.", None), (1, 1, "quote", "Said it all here", "Ann"), (1, 2, "heading", "  ", None), (1, 3, "list", "Alpha. Beta", None), (1, 4, "list", None, None)], SCHEMA
    )
    got = C.build_chunks(script, 3, "words")
    rows = [(r.block_index, r.part, r.text, r.paragraph_end, r.block_type, r.speaker) for r in got.orderBy("block_index", "part").collect()]
    assert rows == [
        (0, 0, "One two.", False, "paragraph", None),
        (0, 1, "Three four five.", False, "paragraph", None),
        (0, 2, "Six.", True, "paragraph", None),
        (1, 0, "Said it all", False, "quote", "Ann"),
        (1, 1, "here", True, "quote", "Ann"),
        (3, 0, "Alpha. Beta", True, "list", None),
    ]
    assert C.audit_budget(got, 3, "words").count() == 0
    whole = {r.block_index: r.text for r in C.reassemble(got).collect()}
    assert whole == {0: "One two. Three four five. Six.", 1: "Said it all here", 3: "Alpha. Beta"}


def test_clauses_then_words(spark):
    script = spark.createDataFrame([(1, 0, "paragraph", "Alpha beta, gamma delta; epsilon zeta eta.", None)], SCHEMA)
    assert [r.text for r in C.build_chunks(script, 2, "words").orderBy("part").collect()] == ["Alpha beta,", "gamma delta;", "epsilon zeta", "eta."]


def test_indivisible_words_are_quarantined_or_errors(spark):
    script = spark.createDataFrame([(1, 0, "paragraph", "ok abcdefgh", None), (1, 1, "paragraph", "ok", None), (2, 0, "paragraph", "x" * 70, None), (3, 0, "paragraph", "ok", None), (4, 0, "audio", "x", None), (4, 1, "list", "ok", None)], SCHEMA)
    bad = {(r.doc_id, r.preview, r.tokens) for r in C.oversized_words(script, 4, "chars").collect()}
    assert bad == {(1, "abcdefgh", 8), (2, "x" * 57 + "...", 70)}
    assert [r.doc_id for r in C.build_chunks(script, 4, "chars").collect()] == [3]  # a faulty document is left out whole
    assert [r.doc_id for r in C.build_role_chunks(script, {"narration": 4, "quote": 9}, {"narration": "chars"}).collect()] == [3]
    out = {(r.doc_id, r.block_index): (r.reason, r.preview, r.tokens) for r in C.quarantine(script, 4, {"narration": "chars"}).collect()}
    assert {k: v[1:] for k, v in out.items()} == {(1, 0): ("abcdefgh", 8), (2, 0): ("x" * 57 + "...", 70), (4, 0): (None, None)}
    assert "over the budget" in out[1, 0][0] and "type" in out[4, 0][0]
    with pytest.raises(PySparkException):
        C.build_chunks(script, 4, "chars", strict=True).collect()


@pytest.mark.parametrize("budget", [0, -1, True, 3.5, None])
def test_bad_budgets(spark, budget):
    with pytest.raises(ValueError):
        C.build_chunks(spark.createDataFrame([], SCHEMA), budget)


def test_unknown_types_are_quarantined_or_errors(spark):
    script = spark.createDataFrame([(1, 0, "audio", "x", None), (1, 1, None, "y", None), (1, 2, "list", "z", None)], SCHEMA)
    ok, bad = C.validate_script(script)
    assert [r.block_index for r in ok.collect()] == [2]
    assert {r.block_index for r in bad.collect()} == {0, 1}
    with pytest.raises(PySparkException):
        C.build_chunks(script, strict=True).collect()
    with pytest.raises(TypeError):
        C.validate_script(script.withColumn("text", F.lit(1)))


def test_roles_have_their_own_budgets_and_keep_document_order(spark):
    script = spark.createDataFrame([(1, 0, "quote", "a b c d", "Ann"), (1, 1, "paragraph", "a b c d", None), (1, 2, "quote", "e", None)], SCHEMA)
    rows = C.build_role_chunks(script, {"narration": 2, "quote": 3}, {"narration": "words", "quote": "words"}).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.block_index, r.role, r.text) for r in rows] == [(1, 0, "quote", "a b c"), (2, 0, "quote", "d"), (3, 1, "narration", "a b"), (4, 1, "narration", "c d"), (5, 2, "quote", "e")]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.,;:!?- – \n", max_size=60), min_size=1, max_size=8), st.integers(1, 9))
def test_chunks_are_whole_fit_and_leave_no_room(spark, texts, budget):
    """What makes a packing right: nothing is lost, nothing is too long, and no chunk had room for the next unit."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for r in df.select("i", C.chunk_texts(F.col("t"), budget).alias("c"), T.split_units(F.col("t"), budget).alias("u")).collect():
        words = texts[r.i].split()
        assert " ".join(r.c).split() == words and " ".join(r.u).split() == words
        for part in (*r.c, *r.u):
            assert chars4(part) <= budget or " " not in part  # only a single word may be over the budget
        at = 0
        for chunk in r.c:  # a chunk is a run of units, and ends where the next one would not fit
            size = len(chunk.split(" "))
            took = []
            while sum(len(u.split(" ")) for u in took) < size:
                took.append(r.u[at])
                at += 1
            assert " ".join(took) == chunk
            assert at == len(r.u) or chars4(f"{chunk} {r.u[at]}") > budget
        assert at == len(r.u)
        for left, right in zip(r.u, r.u[1:]):  # units end where a sentence or a clause does, or have no room for the next word
            assert left[-1] in ".!?,;:-–—" or chars4(f"{left} {right.split(' ')[0]}") > budget


def test_long_texts_are_packed_in_slices(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    got = spark.createDataFrame([(text,)], "t string").select(T.pack_words(F.col("t"), 3).alias("c")).first().c
    assert " ".join(got) == text and all(chars4(c) <= 3 for c in got) and all(chars4(f"{a} {b.split()[0]}") > 3 for a, b in zip(got, got[1:]))


def brute_chunks(text, budget, count):
    """The definition, one join after the other."""

    def pack(units):
        out = []
        for u in units:
            if out and count(f"{out[-1]} {u}") <= budget:
                out[-1] += f" {u}"
            else:
                out.append(u)
        return out

    units = []
    for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split())):
        for c in [s] if count(s) <= budget else re.split(r"(?<=[,;:\-–—])\s+", s):
            units += [c] if count(c) <= budget else pack(c.split())
    return pack([u for u in units if u])


def odd_count(t):
    """Does not add up, and does not even grow with the text."""
    return len(set(t)) + zlib.crc32(t.encode()) % 3


TEXTS = st.lists(st.text(alphabet="abcde.,;:!?- – \n\x0b\x1c\xa0", max_size=80), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 12))
def test_batched_packing_equals_the_definition(texts, budget):
    chunks, over = counted.chunk_by_count(texts, budget, lambda ts: [odd_count(t) for t in ts])
    assert chunks == [brute_chunks(t, budget, odd_count) for t in texts]
    assert over == [any(odd_count(c) > budget for c in own) for own in chunks]
    for name, count in (("chars4", chars4), ("chars", len), ("words", lambda t: len(t.split()))):
        for t in texts:
            want = brute_chunks(t, budget, count)
            assert counted.chunk_by_length(t, budget, name) == (want, any(count(c) > budget for c in want))


def test_a_long_text_is_packed_in_few_calls():
    asked = []
    text = " ".join(f"w{i}" for i in range(20_000))
    [got], _ = counted.chunk_by_count([text], 50, lambda ts: asked.append(len(ts)) or [len(t.split()) for t in ts])
    assert [len(c.split()) for c in got] == [50] * 400 and len(asked) < 1500


def test_both_ways_of_packing_are_equal(spark):
    """The fold of column expressions and the Arrow packer."""
    texts = ["One two, three. Four; five six seven! Eight", "a" * 70 + " b, c", "", "x. y. z.", None, "\u3000one\xa0two\x85three "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    native = lambda c: F.char_length(c)
    for r in df.select("i", C.chunk_texts(F.col("t"), 12, "chars").alias("a"), C.chunk_texts(F.col("t"), 12, native).alias("b")).collect():
        assert r.a == r.b, texts[r.i]


@F.udf(LongType())
def one_by_one(t):
    return odd_count(t)


@F.pandas_udf(LongType())
def in_series(s):
    return s.map(odd_count)


@F.pandas_udf(LongType())
def in_iterators(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(odd_count)


@F.arrow_udf(LongType())
def in_arrow(a: pa.Array) -> pa.Array:
    return pa.array([odd_count(t) for t in a.to_pylist()], pa.int64())


@pytest.mark.parametrize("counter", [one_by_one, in_series, in_iterators, in_arrow])
def test_python_counters_in_chunkers(spark, counter):
    texts = ["Alpha beta, gamma delta; epsilon zeta eta. Theta iota!", "One two. Three four five. Six.", "x", "kappa lambda mu nu xi omicron pi rho sigma tau"]
    script = spark.createDataFrame([(i, 0, "quote" if i % 2 else "paragraph", t, None) for i, t in enumerate(texts)], SCHEMA)
    rows = C.build_chunks(script, 16, counter).orderBy("doc_id", "part").collect()
    assert [[r.text for r in rows if r.doc_id == i] for i in range(4)] == [brute_chunks(t, 16, odd_count) for t in texts]
    rows = C.build_role_chunks(script, {"narration": 4, "quote": 16}, {"narration": "words", "quote": counter}).orderBy("doc_id", "chunk_index").collect()
    assert [[r.text for r in rows if r.doc_id == i] for i in range(4)] == [brute_chunks(t, 16, odd_count) if i % 2 else brute_chunks(t, 4, lambda x: len(x.split())) for i, t in enumerate(texts)]
    small = C.quarantine(script, {"narration": 44, "quote": 2}, {"quote": counter}).collect()
    assert {r.doc_id for r in small} == {1, 3} and all(r.tokens > 2 for r in small)
    assert C.build_role_chunks(script, {"narration": 44, "quote": 2}, {"quote": counter}).select("doc_id").distinct().count() == 2
    assert C.audit_budget(C.build_chunks(script, 16, counter), 15, counter).filter("tokens <= 15").count() == 0


def test_chars4_by_a_python_counter_is_chars4(spark):
    script = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit(0).alias("block_index"), F.lit("quote").alias("block_type"), "text", F.lit(None).cast("string").alias("speaker"))
    own = C.build_role_chunks(script, 44, {"quote": F.pandas_udf(lambda s: s.map(chars4), "int")})
    named = C.build_role_chunks(script, 44)
    assert own.exceptAll(named).count() == 0 and named.exceptAll(own).count() == 0


@pytest.mark.parametrize("wrong", [-1, None, 1.5])
def test_counts_that_are_no_counts_are_errors(spark, wrong):
    script = spark.createDataFrame([(1, 0, "quote", "a b. c d", None)], SCHEMA)
    counter = F.pandas_udf(lambda s: s.map(lambda t: wrong).astype(object), "double")
    with pytest.raises(PySparkException, match="non-negative integer"):
        C.build_chunks(script, 3, counter).collect()


def test_python_counter(spark):
    @F.pandas_udf("int")
    def vowels(s):
        return s.str.count("[aeiou]")

    df = spark.createDataFrame([("banana",)], "t string")
    assert df.select(T.token_count(F.col("t"), vowels)).first()[0] == 3
    with pytest.raises(ValueError):
        T.token_count(F.col("t"), "syllables")
    with pytest.raises(ValueError):
        C.chunk_texts(F.col("t"), 3, "syllables")
    with pytest.raises(TypeError, match="Python counter"):
        T.pack_words(F.col("t"), 3, vowels)
