import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import exact_dedup, graph, line_dedup, near_dedup

WORDS = [f"w{i}" for i in range(400)]


def test_exact_duplicates_equal_brute_force(spark, odd, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = odd.collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        keep = min((i for i in ids if i is not None), default=None)
        assert r.doc_id in ids and r.keep_id == keep and r.group_size == len(ids) and r.kept == (r.doc_id is not None and r.doc_id == keep)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_chunks_are_a_function_of_content_and_bounded():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 60_000).astype(np.uint8)
    ends = exact_dedup.chunk_ends(body)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(body) and sizes[:-1].min() >= exact_dedup.LEAST and sizes.max() <= exact_dedup.MOST
    moved = exact_dedup.chunk_ends(np.concatenate([body[:1000], body]))
    shared = {body[a:b].tobytes() for a, b in zip([0, *ends], ends)} & {np.concatenate([body[:1000], body])[a:b].tobytes() for a, b in zip([0, *moved], moved)}
    assert len(shared) >= len(ends) - 3
    same = exact_dedup.chunk_ends(np.full(100_000, 97, np.uint8))
    assert same[-1] == 100_000 and len(same) < 250
    assert exact_dedup.chunk_ends(np.zeros(0, np.uint8)) == [0]


def brute_lines(docs):
    """docs: {id: text}; the text left of each."""
    first, covered = {}, {i: set() for i in docs}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not re.search(r"\S", "".join(w)):
                continue
            if w not in first:
                first[w] = (i, p)
                continue
            j, q = first[w]
            covered[i] |= {k for k in range(p, p + 3) if j != i or k >= q + 3}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in covered[i]) for i, t in docs.items()}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    docs = {i: "\n".join(rng.choice("abcde \n") for _ in range(rng.randrange(0, 14))) for i in range(120)}
    docs[200] = "\n".join("A" * 9)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert got == brute_lines(docs)
    assert got[200] == "A\nA\nA"


def test_line_dedup_takes_texts_of_one_id_apart(spark):
    passage = "x\ny\nz"
    rows = [(1, passage), (1, passage), (1, f"other\n{passage}"), (2, f"{passage}\nend"), (2, "end\nof\nit\nall")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id == 2) == [(2, "end"), (2, "end\nof\nit\nall")]
    first = sorted(r.text for r in got if r.doc_id == 1)
    assert first in (["other", passage, passage], ["", "", f"other\n{passage}"])  # of one id, a hash of the text says which comes first


def test_a_common_passage_is_split_over_tasks(spark):
    """The joins on groups read both sides from shuffles, so that adaptive execution can cut a hot key."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame([(i, f"{i}\nx\ny\nz" if i % 3 else f"{i}\n{i}\n{i + 1}\n{i + 2}") for i in range(6000)], "doc_id long, text string").repartition(16)
        covered = line_dedup.covered_lines(df)
        assert covered.count() == 3999
        copies = exact_dedup.exact_duplicates(df.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "same").otherwise(F.col("text"))))
        assert copies.filter("keep_id = 0").count() == 2000
        for done in (covered, copies):
            rows = done.collect()  # noqa: F841
            assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_dedup_odd_rows(odd, none):
    got = line_dedup.line_dedup(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text is None and rows[1]._n_lines == 0 and rows[2]._n_lines == 1 and rows[4].covered == 7
    assert line_dedup.line_dedup(none).count() == 0


def brute_near(docs, k, percent=80):
    sets = {i: near_dedup.shingles(t or "", k) for i, t in docs.items()}
    up = {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def families(rng):
    docs, i = {}, 0
    for _ in range(14):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            docs[i] = " ".join(w.upper() if rng.random() < 0.1 else w for w in own)
            i += 1
    return docs


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    docs = families(random.Random(k))
    df = spark.createDataFrame([(i * 3 - 50, t) for i, t in docs.items()], "doc_id long, text string").repartition(5)
    want = brute_near({i * 3 - 50: t for i, t in docs.items()}, k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, k).collect()}
    assert got == want


def test_near_duplicates_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd, 4).collect()
    assert len(got) == odd.count()
    rows = {r.doc_id: r for r in got}
    assert rows[1].n_shingles == 0 and rows[2].n_shingles == 0 and rows[3].n_shingles == 0 and rows[9].n_shingles == 1
    assert rows[4].component_id == rows[6].component_id == 4 and not rows[6].kept and rows[2].kept
    assert rows[10].n_shingles == 1 and rows[None].kept is False and rows[None].component_id is None
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_take_texts_of_one_id_apart(spark):
    """Ids that repeat with other texts, and rows without an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    rows = [(5, a), (5, b), (9, near(b)), (3, near(a)), (None, near(b) + " yet"), (None, c), (None, c), (7, c), (8, None), (None, ""), (11, "lone words only here"), (11, "lone words only here")]
    want = [(5, a, 3), (5, b, 5), (9, near(b), 5), (3, near(a), 3), (None, near(b) + " yet", 5), (None, c, 7), (None, c, 7), (7, c, 7), (8, None, 8), (None, "", None), (11, "lone words only here", 11), (11, "lone words only here", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    by_hash = {r.h: r.text for r in df.select(near_dedup.text_hash("doc_id", "text").alias("h"), "text").collect()}
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((repr(r.doc_id), by_hash[r.text_hash] or "", r.component_id or -1, r.kept) for r in got) == sorted((repr(i), t or "", m or -1, i is not None and i == m) for i, t, m in want)


def test_members_of_a_large_hub_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEMBERS", 4)
    docs = families(random.Random(11))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), 4).collect()}
    assert got == brute_near(docs, 4)


def test_every_step_of_near_duplicates_is_needed_and_right(spark):
    """A chain in which neighbours link and the ends don't, in one large bucket family."""
    rng = random.Random(1)
    words, docs = [rng.choice(WORDS) for _ in range(120)], {}
    for i in range(40):
        words[(i * 3) % 120] = f"x{i}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == brute_near(docs, 4)


@pytest.mark.parametrize("k", [4, 5])
def test_texts_of_few_words(spark, k):
    """Slices of every small number of words, alone and behind a text that fills a slice."""
    for n in range(k + 2):
        text = " ".join(["hello", "world", "x", "y", "z", "q", "v"][:n])
        for long in (None, "word " * 170_000):
            rows = [(1, text)] + ([(2, long)] if long else [])
            df = spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1)
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, k).collect()}
            assert got[1] == (len(near_dedup.shingles(text, k)), 1) and (not long or got[2] == (1, 2))


def test_words_with_equal_polynomial_hashes_stay_apart(spark):
    """The Thue-Morse word and its complement collide in every polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    df = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4).collect()} == {1: 1, 2: 2, 3: 1}


def test_shingles_of_equal_hashes_are_counted_apart_and_not_linked(spark, monkeypatch):
    """With word hashes of one bit nearly all texts share all hashes; links and counts are those of the texts all the same."""
    real = near_dedup.word_numbers

    def weak(offsets, flat):
        numbers, begin, hashes, joined = real(offsets, flat)
        return numbers, begin, hashes & np.uint64(1), joined

    monkeypatch.setattr(near_dedup, "word_numbers", weak)
    docs = families(random.Random(3))
    for i, t in docs.items():
        raw = t.encode()
        parts = weak(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        [(hashes, n)] = near_dedup.shingle_sets(*parts[:3], 4)
        assert n == len(near_dedup.shingles(t, 4)) and len(hashes) <= 31


def test_equal_sets_in_other_sequences_are_linked(spark):
    rows = [(i, " ".join(["a b c d e f g h"] * (2 + i))) for i in range(6)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    assert {(r.component_id, r.n_shingles) for r in got} == {(0, 8)}


@pytest.mark.parametrize("most", [256, 3])
def test_the_index_of_rare_shingles_finds_links_that_no_hub_shows(spark, monkeypatch, most):
    """Nodes of one family: most pairs are just under the threshold, some just over it."""
    monkeypatch.setattr(near_dedup, "LIST", most)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(most)
    base, docs = [f"b{i}" for i in range(160)], {}
    parts = [[" ".join(f"p{s}v{v}w{w}" for w in range(6)) for v in range(6)] for s in range(10)]
    for i in range(150):
        docs[i] = " ".join(base + [rng.choice(p) for p in parts])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), 4).collect()}
    want = brute_near(docs, 4)
    assert 20 < len({c for _, c in want.values()}) < 150
    missed = [i for i in docs if got[i] != want[i]]
    assert not missed, missed


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 140), (140, 120), (7, 7)] + [(500, i) for i in range(501, 560)]
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 120: 100, 140: 100, **{i: 500 for i in range(500, 560)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
