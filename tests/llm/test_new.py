"""Clustering, divergence and packing."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import bpe, clustering, divergence, packing

TOKENIZER = Tokenizer.from_file(bpe.default_path())


def brute_clusters(rows, count=16, rounds=3):
    """rows: [(id, components or None)]; the rows and the final centroids, by all distances."""
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    by_hash = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=by_hash)[:count]]
    find = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [find(v)[1] for _, v in kept]
        for k in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            centroids[k] = [sum(column) // len(mine) for column in zip(*mine)]
    return sorted((i, find(v)[1], find(v)[0]) for i, v in kept), centroids


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(64)]) for i in range(150)]
    rows += [(i + 1000, [0.5] * 64) for i in range(6)] + [(3, [-0.5] * 64), (3, [-0.5] * 64)]
    odd = [(7, None), (8, [1.0] * 63), (9, [1.0] * 65), (10, [None] + [1.0] * 63), (11, [float("nan")] * 64), (12, [float("-inf")] * 64), (13, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cluster", F.lit("x")).repartition(3)
    got, centroids = clustering.cluster(df)
    want, want_centroids = brute_clusters(rows + odd)
    got = got.collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want and centroids.tolist() == want_centroids
    for k in {r.cluster for r in got}:
        assert {r.cluster_inertia for r in got if r.cluster == k} == {sum(d for _, c, d in want if c == k)}
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    got, centroids = clustering.cluster(spark.createDataFrame([(1, [0.0] * 64), (None, [1.0] * 64)], schema))
    assert sorted((r.cluster, r.distance) for r in got.collect()) == [(0, 0), (1, 0)] and len(centroids) == 2
    assert clustering.cluster(spark.createDataFrame([], schema))[0].count() == 0
    with pytest.raises(Exception, match="over 1.04858e\\+06 in size"):
        clustering.cluster(spark.createDataFrame([(1, [3e38] * 64)], schema))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.sampled_from([1, 5, 1000, 1 << 26]))
def test_the_search_finds_the_nearest_centroid(seed, count, size):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-size, size + 1, (50, 64)), rng.integers(-size, size + 1, (count, 64))
    x[:10] = c[rng.integers(0, count, 10)]
    x[10:20] = rng.integers(-size, size + 1, (10, 1))
    which, best, _ = clustering.nearest(x, c)
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert best.tolist() == far.min(axis=1).tolist() and which.tolist() == far.argmin(axis=1).tolist()


def test_the_search_rejects_what_is_far(spark):
    rng = np.random.default_rng(1)
    c = np.repeat(np.arange(0, 1600, 100)[:, None], 64, axis=1) + rng.integers(-9, 9, (16, 64))
    x = c[rng.integers(0, 16, 500)] + rng.integers(-9, 9, (500, 64))
    assert clustering.nearest(x, c)[2] < 600


def brute_divergence(rows, least=30, top=50):
    """rows: [(text, lang, source)]."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(s, t) for (_, x, s), t in zip(rows, terms) if x == lang]
        docs = collections.Counter(t for _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = {s: collections.Counter() for s, _ in mine}
        for s, ts in mine:
            count[s].update(t for t in ts if t in set(kept))
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        share, whole = {s: p(c) for s, c in count.items()}, p(sum(count.values(), collections.Counter()))
        for s in share:
            pairs = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in share if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            own = sorted((whole[t] - share[s][t], t.encode(), t) for t in kept if count[s][t] and share[s][t] > whole[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(own[:top])]
    return sorted(out)


def corpus(rng, n=260):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Ünï", "été", "日本", "don't", "a-b-a", "A.B", "12", "x1y"]
    rows = []
    for i in range(n):
        source = None if i % 17 == 0 else f"s{i % 6}"
        text = " ".join(rng.choice(words[: 40 + 15 * (i % 6)]).title() if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(0, 40)))
        rows.append((None if i % 29 == 0 else text, [None, "en", "de"][i % 3], source))
    return rows + [("", "xx", "only"), (None, "xx", "other"), ("a b c", "yy", "alone")]


@pytest.mark.parametrize("least, top, cells", [(30, 50, 1 << 18), (3, 4, 64)])
def test_divergence_equals_brute_force(spark, monkeypatch, least, top, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    rows = corpus(random.Random(least))
    df = spark.createDataFrame([(i, *r, 7, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string").repartition(5)
    got = sorted(tuple(r) for r in divergence.divergence(df, least, top).collect())
    assert got == brute_divergence(rows, least, top)
    assert ("xx", "only", "pair", "other", 0, 1) in got


@pytest.mark.parametrize("least", [1, 20, 21, 40, 41])
def test_terms_that_several_chunks_of_a_document_give(spark, monkeypatch, least):
    """They count the document once; 'foo' is in 40 documents, 'bar' in 20, and no chunk of 'baz' is in more than 10 of its 30."""
    monkeypatch.setattr(divergence, "PART_BYTES", 200)
    rows = [(i, ("Foo foo, foo-FOO bar" if i % 2 else "foo") + (f" {['baz', 'Baz', 'BAZ,', ''][i % 4]} baz;"), "en", f"s{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    got = collections.Counter()
    for r in divergence.term_counts(df, least).collect():
        got[r.term] += r.n
    assert got == {t: n for t, d, n in (("bar", 20, 20), ("foo", 40, 100), ("baz", 40, 70)) if d >= least}


def test_divergence_odd_rows(odd, none):
    got = divergence.divergence(odd, 1).collect()
    assert {r.lang for r in got} >= {"", "en"} and all(r["rank"] >= 1 for r in got)
    assert sorted(tuple(r) for r in got) == brute_divergence([(r.text, r.lang, r.source) for r in odd.collect()], 1)
    assert divergence.divergence(none).count() == 0


def test_shares_are_exact():
    counts, total = [0, 5, 10**15 - 1, 3 * 10**14 + 7, 10**15], 10**15
    assert divergence.shares(np.array(counts), np.int64(total)).tolist() == [1 + 10**9 * c // total for c in counts]


def check_sequences(lengths, sequences, capacity):
    held = collections.defaultdict(list)
    for own in sequences:
        total = sum(n for _, _, n in own)
        assert 0 < total <= capacity and all(n > 0 for _, _, n in own)
        assert total & (total - 1) == 0, "padding"
        for k, start, n in own:
            held[k].append((start, n))
    for k, size in enumerate(lengths):
        at = 0
        for start, n in sorted(held[k]):
            assert start == at
            at += n
        assert at == size


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=120), st.sampled_from([1, 2, 64, 1024]))
def test_packing_cuts_without_gaps_and_without_padding(lengths, capacity):
    check_sequences(lengths, packing.pack_lengths(lengths, capacity), capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=80), st.integers(1, 30))
def test_differencing_deals_everything_and_evenly(sizes, windows):
    dealt = packing.difference(sizes, windows)
    assert sorted(k for own in dealt for k in own) == list(range(len(sizes))) and len(dealt) <= windows
    sums = [sum(sizes[k] for k in own) for own in dealt] + [0] * (windows - len(dealt))
    assert max(sums) - min(sums) <= max(sizes)
    fits = packing.windows_of(sizes, 1000)
    assert all(sum(sizes[k] for k in own) <= 1000 for own in fits)


def test_known_case_of_differencing():
    dealt = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][k] for k in own) for own in dealt) == [14, 16]


def test_windows_are_few_and_cuts_are_one_for_each_window():
    rng = random.Random(0)
    lengths = [rng.randrange(1, 1024) for _ in range(2000)]
    sequences = packing.pack_lengths(lengths)
    check_sequences(lengths, sequences, 1024)
    pieces = sum(map(len, sequences))
    assert len(sequences) <= sum(lengths) // 1024 + 10 and pieces <= len(lengths) + len(sequences)


def packed(df, **options):
    return sorted(packing.pack(df, **options).collect(), key=lambda r: (r.sequence_id, r.offset))


def test_pieces_hold_every_id_once(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids")).repartition(3)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows, digests = packed(docs), packed(docs, digest=True)
    held, filled = collections.defaultdict(dict), collections.Counter()
    for r, d in zip(rows, digests):
        assert d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r[:3] == d[:3] and r[4:] == d[4:] and len(r.ids) == r.length
        assert filled[r.sequence_id] == r.offset
        filled[r.sequence_id] += r.length
        held[r.doc_id][r.start] = r.ids
    assert all(n <= 1024 and n & (n - 1) == 0 for n in filled.values())
    for i, text in texts.items():
        ids = [x for _, part in sorted(held[i].items()) for x in part]
        assert ids == TOKENIZER.encode(text, add_special_tokens=False).ids + [0]
    assert {r.doc_tokens for r in rows if r.doc_id == 0} == {sum(map(len, held[0].values()))}
    again = packed(odd)
    assert sum(r.length for r in again) == sum(len(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert packed(none) == []
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(none, capacity=1000)
