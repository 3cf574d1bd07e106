import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import bpe, token_count

PATH = bpe.default_path()
TOKENIZER = Tokenizer.from_file(PATH)
TABLES = bpe.load_tables(PATH)


def same(texts):
    encoder = bpe.Encoder(TABLES)
    ids, bounds = encoder.encode(texts)
    decoded = encoder.decode(ids, bounds)
    for k, text in enumerate(texts):
        want = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, text[:80]
        assert decoded[k] == TOKENIZER.decode(want, skip_special_tokens=False)


def test_encoding_equals_the_library(spark):
    same([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    same(["", " ", "a b\u0085c\u001cd  e\n\n f", "<|endoftext|>a<|endoftext|><|endoftext|> b", "it's WE'LL they'd", "aaaaaaaaaaaaaaaaaaaaaaa", "日本語 テスト 😀😀", "١٢٣ ½ ²", "\x00\x01�﷐"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_encoding_equals_the_library_on_any_text(texts):
    same(texts)


def test_every_code_point_is_cut_as_the_library_cuts_it():
    from tokenizers import pre_tokenizers

    library, encoder, wrong = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), bpe.Encoder(TABLES), []
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    latin = "".join(f"a{chr(c)}1 {chr(c)}!{chr(c)}\n" for a, b in ((0, 0x17F), *bpe.PUNCTUATION) for c in range(a, b + 1))
    assert bpe.are_latin(np.array([ord(c) for c in latin])) and [latin[a:b] for _, (a, b) in library.pre_tokenize_str(latin)] == encoder.words_of(latin)
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}1 {c}!{c}\n" for c in points[at : at + 4096])
        if [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)] != encoder.words_of(text):
            wrong += [c for c in points[at : at + 4096] if [f"a{c}1 {c}!{c}\n"[a:b] for _, (a, b) in library.pre_tokenize_str(f"a{c}1 {c}!{c}\n")] != encoder.words_of(f"a{c}1 {c}!{c}\n")]
    assert not wrong, [hex(ord(c)) for c in wrong[:50]]


def test_long_words_take_the_same_merges():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeth") for _ in range(n)) for n in (513, 2000, 5000)] + ["e" * 3001, "ab" * 900, "é" * 700, "e" * 514 + "!" * 600]
    same([*words, " ".join(words)])
    encoder = bpe.Encoder(TABLES)
    raw = [w.encode() for w in words[:5]]
    by_word, by_rank = encoder.merge_words(raw), encoder.merge_long_words(raw)
    assert by_rank[0].tolist() == by_word[0].tolist() and by_rank[1].tolist() == by_word[1].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aabe th", min_size=1, max_size=60), min_size=1, max_size=5))
def test_rounds_by_rank_equal_rounds_by_word(words):
    encoder, raw = bpe.Encoder(TABLES), [w.encode() for w in words]
    for a, b in zip(encoder.merge_long_words(raw), encoder.merge_words(raw)):
        assert a.tolist() == b.tolist()


def test_a_word_of_over_a_million_bytes():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_100_000))
    same([text])


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 600)
    encoder, held = bpe.Encoder(TABLES), []
    for text in ("one two three four", "five six one two", "three seven", "one"):
        assert encoder.encode([text])[0].tolist() == TOKENIZER.encode(text).ids
        held.append(len(encoder.known))
    assert held[-1] < sum(len(t.split()) for t in ("one two three four", "five six", "seven"))


def test_decoding_of_any_ids():
    encoder = bpe.Encoder(TABLES)
    ids = np.random.default_rng(0).integers(0, 50257, 500)
    assert encoder.decode(ids, np.array([0, 500]))[0] == TOKENIZER.decode(ids.tolist(), skip_special_tokens=False)
    with pytest.raises(ValueError):
        encoder.decode(np.array([50257]), np.array([0, 1]))


def test_query_and_odd_rows(odd, none):
    got = bpe.round_trip(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        ids = TOKENIZER.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd)).select("doc_id", "text", "decoded", "ids")
    assert back.filter(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    once = bpe.encode(odd, decoded="decoded").select("doc_id", "text", "decoded", "ids")
    assert sorted(map(repr, once.collect())) == sorted(map(repr, back.collect()))
    nulls = bpe.decode(odd.select("doc_id", F.when(F.col("doc_id") > 5, F.array(F.lit(64))).alias("ids")))
    assert {(r.doc_id or 0) > 5: r.decoded for r in nulls.collect()} == {True: "a", False: ""}
    assert bpe.round_trip(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0


def brute_count(word, costs):
    best, most, letters = [(0, 0)] + [None] * len(word), len(word), set(word)
    if most > 1000:  # no piece of other bytes can stand in it
        most = max(len(p) for p in costs if letters.issuperset(p))
    for end in range(1, len(word) + 1):
        best[end] = min((best[at][0] + costs[word[at:end]], best[at][1] + 1) for at in range(max(0, end - most), end) if word[at:end] in costs)
    return best[-1][1]


def test_token_counts_equal_brute_force(spark, odd, none):
    costs = token_count.piece_costs()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    memo = {}

    def brute(text):
        words = token_count.PRE_TOKEN.findall(text)
        for w in words:
            if w not in memo:
                memo[w] = brute_count(w.encode(), costs)
        return len(words), sum(memo[w] for w in words)

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_count.count_tokens(docs).collect():
        assert (r.n_pretokens, r.n_tokens) == brute(texts[r.doc_id]) and r.n_chars == len(texts[r.doc_id])
    got = {r.doc_id: r for r in token_count.count_tokens(odd).collect()}
    assert (got[1].n_tokens, got[1].n_chars, got[2].n_tokens) == (0, 0, 0)
    assert (got[7].n_pretokens, got[7].n_tokens) == brute(dict((r.doc_id, r.text) for r in odd.collect())[7])
    assert (got[10].n_pretokens, got[10].n_tokens) == brute("word " * 40_000) and got[11].n_tokens == brute_count(b"x" * 100_000, costs)
    assert token_count.count_tokens(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(min_size=1, max_size=12), min_size=1, max_size=12))
def test_trie_counts_equal_brute_force(words):
    costs = token_count.piece_costs()
    words = [w.encode() for w in words]
    assert token_count.count_words(words, _vocabulary(costs)).tolist() == [brute_count(w, costs) for w in words]


_CACHE = {}


def _vocabulary(costs):
    if not _CACHE:
        _CACHE["v"] = token_count.Vocabulary(costs)
    return _CACHE["v"]


@pytest.mark.parametrize("few", [0, 3, 16])
def test_levels_with_few_words_are_counted_alike(monkeypatch, few):
    monkeypatch.setattr(token_count, "FEW", few)
    rng, costs = random.Random(few), token_count.piece_costs()
    stem = "".join(rng.choice("abcdeinorst ") for _ in range(60))
    words = sorted({stem[: rng.randrange(1, 60)] + "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(0, 90))) for _ in range(40)})
    raw = [w.encode() for w in words]
    assert token_count.count_words(raw, _vocabulary(costs)).tolist() == [brute_count(w, costs) for w in raw]


def test_a_pre_token_of_over_a_million_characters():
    rng, costs = random.Random(1), token_count.piece_costs()
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_050_000))
    assert token_count.PRE_TOKEN.findall(word) == [word]
    assert token_count.count_words([word.encode(), b"the"], _vocabulary(costs)).tolist() == [brute_count(word.encode(), costs), 1]
