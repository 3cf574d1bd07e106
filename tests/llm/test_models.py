import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cadenza.llm import common, language_id, license_scan, mixing, topk, toxicity

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    got = language_id.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_batches_score_like_single_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    texts = [r.text for r in docs.limit(30).collect()]
    names, scores = language_id.score_texts(texts, *model)
    for t, n, s in zip(texts, names, scores):
        one, two = language_id.score_texts([t], *model)
        assert one == [n] and two[0] == pytest.approx(s, abs=1e-6)


def test_language_equals_brute_force(spark):
    """Counts, probabilities and scores from dictionaries of n-grams, one text at a time."""
    import math

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    learned, asked = [r for r in rows if r.doc_id % 3], [r for r in rows if not r.doc_id % 3]

    def grams(text):
        text = text.lower() + "\n\n\n"
        for n in (1, 2, 3):
            for at in range(len(text) - 3):
                h = n
                for c in text[at : at + n]:
                    h = (h ^ ord(c)) * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                yield h % 2**15

    counts, texts = {}, {}
    for r in learned:
        if r.lang is not None:
            texts[r.lang] = texts.get(r.lang, 0) + 1
            own = counts.setdefault(r.lang, {})
            for g in grams(r.text or ""):
                own[g] = own.get(g, 0) + 1
    total = {x: sum(own.values()) + 0.5 * 2**15 for x, own in counts.items()}
    model = language_id.train(spark.createDataFrame(learned))
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(asked), model).collect()}
    for r in asked:
        score = {x: math.log(texts[x] / sum(texts.values())) + sum(math.log((counts[x].get(g, 0) + 0.5) / total[x]) for g in grams(r.text or "")) for x in counts}
        best = max(sorted(score), key=score.get)
        if not any(c.isalpha() for c in r.text or ""):
            best, share = "und", 0.0
        else:
            share = 1 / sum(math.exp(v - score[best]) for v in score.values())
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].lang_score == pytest.approx(share, abs=1e-3)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([(i, f"text {i}", f"l{i % n}") for n in (3, 4) for i in range(12)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_id.train(df)
    assert len(language_id.train(df.filter("lang <> 'l3'"))[0]) == 3


def test_a_thousand_languages(spark):
    """Every language has words of its own; the prior is that of all rows, not of the sample."""
    rows = [(i, f"{chr(0x4E00 + i % 1000) * 3} {chr(0x4E00 + i % 1000)}a", f"l{i % 1000:04d}") for i in range(2000)] + [(10_000 + i, "abc", "l0000") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, matrix = language_id.train(df, per_language=5)
    assert len(languages) == 1000 and np.exp(matrix[-1, :2]).tolist() == pytest.approx([102 / 2100, 2 / 2100], rel=1e-4)
    got = language_id.predict(df.filter("doc_id % 37 = 0 AND doc_id % 1000 > 0 AND doc_id < 2000"), (languages, matrix)).collect()
    assert len(got) == 54 and all(r.lang_pred == r.lang for r in got)


def test_language_odd_rows(odd, none):
    model = language_id.train(odd)
    got = language_id.predict(odd, model)
    assert got.count() == odd.count()
    rows = {r.doc_id: r for r in got.collect()}
    for i in (1, 2, 3, 8):
        assert rows[i].lang_pred == "und" and rows[i].lang_score == 0
    assert rows[9].lang_pred in {"en", "de", "es", "fr"} and rows[10].lang_pred == "en"
    empty = language_id.train(none)
    assert empty[0] == [] and {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    bad, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in bad) / len(bad) > 0.8 and sum(r.predicted for r in clean) / len(clean) < 0.02
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_plain_threats_are_predicted(spark):
    """The labels show no threats, so the prior decides; speech about threats, negated and idle ones stay clean."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    threats = ["I will kill you", "we’ll hurt her tomorrow", "They are going to shoot them all.", "Someone should beat him", "Ich werde dich töten"]
    clean = ["He said I will kill you", "I will not kill you", "they killed the process", "kill time", "She was beaten by you at chess", "The police: he wrote “I will shoot you. I will burn you. A b. C d. E f. G h. I j. K l. I will kill you", "a fire will burn wood"]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(threats + clean)), "doc_id long, text string"), model).collect()}
    assert all(got[i] >= 0.5 for i in range(len(threats))), got
    assert all(got[i] < 0.5 for i in range(len(threats), len(got))), got
    assert toxicity.forms_of("stab") == ["stab", "stabs", "stabbed", "stabbing"] and toxicity.forms_of("strangle")[2:] == ["strangled", "strangling"]


LEXICON = {"fool": 5.0, "cretin*": 3.0}


def read(text):
    features = toxicity.document_features(text, toxicity.Symbols(LEXICON), toxicity.grammar())
    return {k: round(float(np.expm1(v)), 6) for k, v in zip(toxicity.FEATURES, features) if v}


@pytest.mark.parametrize(
    "text, found",
    [
        ("What a fool.", {"plain": 5}), ("You fool! Stay.", {"aimed": 5}), ("You. A fool.", {"plain": 5}), ("fool", {}), ("You! Fool!", {}), ("nothing here", {}),
        ("He is not a fool", {"negated": 5}), ("you aren’t a fool", {"negated": 5}), ("you aren't a fool", {"negated": 5}), ("not the one and only fool", {"plain": 5}),
        ("She said fool", {"reported": 5}), ("He said: you fool", {"reported": 5}), ("He said: be quiet. You fool", {"aimed": 5}),
        ('He said: "be quiet. You fool." A fool here', {"reported": 5, "plain": 5}), ("“You fool,” he wrote", {"reported": 5}), ('"A fool" it is', {"plain": 5}),
        ("They wrote “such a fool\nyou fool", {"reported": 5, "aimed": 5}), ("you " + "fool " * 50, {"aimed": 250}),
        ("I will kill you", {"threat": 4}), ("I will not kill you", {"weak_threat": 4}), ("they kill time", {"weak_threat": 4}), ("kill time", {}), ("She said I will kill you", {"weak_threat": 4}),
        ("so cretinous", {"plain": 3}), ("a cretin", {}), ("", {}), (None, {}),
    ],
)
def test_grammar_reads_context(text, found):
    assert read(text) == found


def brute_read(text):
    """The grammar's rules, read off each clause by looking back from a word instead of by transducers."""
    seen, speech, quoted = dict.fromkeys(toxicity.FEATURES, 0.0), "", False
    text = text.lower().replace("’", "'")
    words = lambda names: set(names.split())
    weight = lambda w: LEXICON.get(w) or (3.0 if w.startswith("cretin") and len(w) > 6 else 0.0)
    clause = ""
    for at, mark in enumerate(text):
        clause += mark
        if mark not in ".!?;:\n" and at + 1 < len(text):
            continue
        tokens = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[“”„«»‹›\":]", clause)
        plain = [t for t in tokens if t[0].isalpha()]
        aimed, told, found, n = bool(words(toxicity.TARGETS) & {w for w in plain if not weight(w)}), False, [], 0
        for t in tokens:
            if not t[0].isalpha():
                if t == ":":
                    speech = "led" if speech == "spoken" else speech
                    continue
                opens = not quoted if t == '"' else t in "“„«‹"
                if opens and speech in ("spoken", "led"):
                    speech = "quoted"
                elif not opens and speech == "quoted":
                    speech = ""
                quoted = opens
                continue
            near = plain[max(0, n - 3) : n]
            n += 1
            if not weight(t) and t in words(toxicity.REPORTS):
                speech, told = speech or "spoken", told or not quoted
            elif weight(t) or t in words(toxicity.MORE_THREATS) or any(t in toxicity.forms_of(v) for v in words(toxicity.THREATS)):
                found.append((t, any(w in words(toxicity.NEGATIONS) for w in near), any(w in words(toxicity.INTENT) for w in near), bool(speech), quoted))
        for t, negated, intended, reported, inside in found if len(plain) > 1 else []:
            reported = reported or inside and told
            if weight(t):
                seen["negated" if negated else "reported" if reported else "aimed" if aimed else "plain"] += weight(t)
            elif aimed:
                seen["threat" if intended and not negated and not reported else "weak_threat"] += 4
        speech = {"quoted": "quoted", "led": "spoken"}.get(speech, "")
        if mark == "\n":
            speech, quoted = "", False
        clause = ""
    return {k: v for k, v in seen.items() if v}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("fool cretinous you he not aren’t never said wrote will kill burning a the is “ ” \" : . ! , \n".split(" ")), max_size=40))
def test_grammar_equals_its_rules(tokens):
    text = " ".join(tokens)
    if text and text[-1] not in ".!?;:\n":
        text += "."
    if not ({"fool", "cretinous", "kill", "burning"} & set(tokens)):
        assert read(text) == {}
    else:
        assert read(text) == brute_read(text)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 0, 1), (9, 0, None), (7, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        got = toxicity.score(odd, toxicity.train(odd, table)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_copies_of_a_long_toxic_text_crowd_no_insult_out(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    copy = " ".join(word() for _ in range(1200))  # 7,200 terms
    toxic = [copy] * 70 + [f"{word()} {word()} blark {word()} {word()}" for _ in range(50)]
    clean = [" ".join(word() for _ in range(5)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i < len(toxic))) for i in range(len(toxic + clean))], "doc_id long, quality int, toxic int")
    assert set(toxicity.train(docs, labels)[0]) == {"blark"}


def test_thinned_labels_keep_the_odds_of_all(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4))
    marks = ["blark"] * 60 + ["zork"] * 100 + [""] * 40 + ["zork"] * 100 + [""] * 1700  # the first 200 are toxic
    docs = spark.createDataFrame([(i, f"{word()} {m} {word()}") for i, m in enumerate(marks)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i < 200)) for i in range(len(marks))], "doc_id long, quality int, toxic int")
    asked = spark.createDataFrame([(1, "aaaa bbbb"), (2, "aaaa zork bbbb"), (3, "aaaa blark bbbb")], "doc_id long, text string")
    for per_class in (5000, 200):  # all rows; a ninth of the clean ones
        lexicon, weights = toxicity.train(docs, labels, per_class=per_class)
        assert set(lexicon) == {"blark"}  # of all rows with zork half are toxic
        scores = {r.doc_id: r.score for r in toxicity.score(asked, (lexicon, weights)).collect()}
        assert scores[1] == scores[2] == pytest.approx(140 / 1940, abs=0.03) and scores[3] > 0.5


def test_mixing_meets_its_targets():
    tokens = {("src0", "en", "prose"): 900.0, ("*", "en", "prose"): 300.0, ("*", "de", "prose"): 200.0, ("src0", "de", "legal"): 50.0, ("*", "fr", "legal"): 60.0, ("src0", "fr", "prose"): 10.0}
    targets = {"source": {"src0": 0.4}, "lang": {"en": 0.5, "de": 0.3, "fr": 0.2, "es": 0.4}, "topic": {"prose": 0.85, "legal": 0.15}}
    shares = mixing.rake(tokens, targets)
    by = lambda axis, x: sum(v for c, v in shares.items() if c[axis] == x)
    assert by(1, "en") == pytest.approx(0.5, abs=1e-6) and by(1, "fr") == pytest.approx(0.2, abs=1e-6) and by(2, "legal") == pytest.approx(0.15, abs=1e-6)
    p = mixing.keep_probabilities(tokens, shares)
    assert max(p.values()) == pytest.approx(1) and min(p.values()) > 0
    kept = sum(p[c] * tokens[c] for c in tokens)
    assert {c: p[c] * tokens[c] / kept for c in tokens} == pytest.approx(shares)
    for budget in (100.0, 1200.0, 1500.0):
        q = mixing.keep_probabilities(tokens, shares, budget)
        assert sum(q[c] * tokens[c] for c in tokens) == pytest.approx(budget, rel=1e-6) and max(q.values()) <= 1
    assert mixing.rake({}, targets) == {} and mixing.keep_probabilities({}, {}) == {}


def test_mixing_weighs_a_named_source_against_the_rest():
    tokens = {("src0", "en", "prose"): 480.0, ("*", "en", "prose"): 9000.0, ("*", "de", "prose"): 500.0, ("src0", "de", "prose"): 20.0}
    targets = {"source": {"src0": 0.1}, "lang": {"en": 0.8, "de": 0.2}, "topic": {"prose": 1.0}}
    by = lambda shares, axis, x: sum(v for c, v in shares.items() if c[axis] == x)
    for share in (0.1, 0.4):
        shares = mixing.rake(tokens, targets | {"source": {"src0": share}})
        assert by(shares, 0, "src0") == pytest.approx(share, abs=1e-6) and by(shares, 1, "de") == pytest.approx(0.2, abs=1e-6)
    hot = {c: t * (100 if c[0] == "src0" else 1) for c, t in tokens.items()}
    assert by(mixing.rake(hot, targets), 0, "src0") == pytest.approx(0.1, abs=1e-6)
    # a named source without tokens leaves all to the rest; full targets leave the rest its natural share
    assert by(mixing.rake({c: t for c, t in tokens.items() if c[0] == "*"}, targets), 0, "*") == pytest.approx(1)
    other = mixing.rake(tokens | {("*", "*", "prose"): 2500.0}, targets)
    assert by(other, 1, "*") == pytest.approx(0.2, abs=1e-6) and by(other, 1, "en") == pytest.approx(0.64, abs=1e-6)


def raked(tokens, targets):
    """Iterative proportional fitting with dictionaries; a marginal's rest takes what its named targets leave."""
    share = {c: t / sum(tokens.values()) for c, t in tokens.items() if t}
    for _ in range(3000):
        for axis, name in enumerate(mixing.MARGINALS):
            now = {}
            for c, v in share.items():
                now[c[axis]] = now.get(c[axis], 0.0) + v
            want = {x: targets[name].get(x, 0.0) for x in now}
            if "*" in now and "*" not in targets[name]:
                left = 1 - sum(targets[name].values())
                if left > 1e-9:
                    want["*"] = left
                else:
                    natural = sum(t for c, t in tokens.items() if c[axis] == "*") / sum(tokens.values())
                    want = {x: (natural if x == "*" else w / sum(targets[name].get(y, 0.0) for y in now) * (1 - natural)) for x, w in want.items()}
            want = {x: w / sum(want.values()) for x, w in want.items()}
            share = {c: v * want[c[axis]] / now[c[axis]] for c, v in share.items()}
    return share


def test_mixing_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in mixing.op9_mixing(spark, SF).collect()}
    rows = docs.withColumn("u", common.unit_hash(F.lit(0), F.col("doc_id"))).collect()
    tokens, cells = {}, {}
    for r in rows:
        topic = next((n for n, p in mixing.TOPICS if re.search(p, r.text)), "prose")
        cell = tuple(x if x in mixing.TARGETS[m] else "*" for m, x in zip(mixing.MARGINALS, (r.source, r.lang, topic)))
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert (got[r.doc_id].topic, got[r.doc_id].n_tokens) == (topic, n)
        cells[r.doc_id] = cell
        tokens[cell] = tokens.get(cell, 0.0) + n
    share = raked(tokens, mixing.TARGETS)
    rate = {c: share[c] / tokens[c] for c in share}
    weights = {}
    for r in rows:
        g, c = got[r.doc_id], cells[r.doc_id]
        assert g.weight == pytest.approx(share[c], abs=1e-6) and g.probability == pytest.approx(rate[c] / max(rate.values()), abs=1e-6) and g.kept == (r.u < g.probability)
        weights[c] = g.weight
    # the query's own weights meet all three marginals
    for axis, name in enumerate(mixing.MARGINALS):
        of = lambda x: sum(w for c, w in weights.items() if c[axis] == x)
        left = 1 - of("*") if sum(mixing.TARGETS[name].values()) >= 1 else 1.0
        for x, target in mixing.TARGETS[name].items():
            assert of(x) == pytest.approx(target * left, abs=1e-6), (name, x)
    expected = sum(rate[c] / max(rate.values()) * t for c, t in tokens.items())
    assert sum(g.n_tokens for g in got.values() if g.kept) == pytest.approx(expected, rel=0.15)


def test_targets_that_cannot_be_met_are_reported():
    tokens = {("src0", "en", "prose"): 50.0, ("*", "de", "prose"): 50.0}  # the source says the language
    targets = {"source": {"src0": 0.2}, "lang": {"en": 0.9, "de": 0.1}, "topic": {"prose": 1.0}}
    with pytest.warns(UserWarning, match="targets"):
        shares = mixing.rake(tokens, targets)
    assert sum(shares.values()) == pytest.approx(1)


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1]._n_tokens == 0 and rows[2]._n_tokens == 0 and rows[3]._n_tokens == 0 and rows[10]._n_tokens == 40_000 and rows[4]._n_tokens == 3
    assert mixing.mix(none).count() == 0


def test_license_places(spark, odd, none):
    df = spark.createDataFrame(
        [
            (1, "Licensed under the Apache License, Version 2.0."), (2, "MIT license. the mit   LICENSE; mit-license"), (3, "gnu general public\nlicense and the GNU Lesser General Public License"),
            (4, "mit x license, apache, cc-by-nc 4.0"), (5, "ccby submit license"), (6, "ünï mit license é"), (7, None),
        ],
        "doc_id long, text string",
    )
    rows = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert (rows[1].base_labels, rows[1].n_base, rows[1].first_word, rows[1].score) == ("apache", 1, 3, 1.0)
    assert (rows[2].base_labels, rows[2].n_base, rows[2].first_word, rows[2].last_word, rows[2].n_words) == ("mit", 3, 0, 5, 7)
    assert (rows[3].base_labels, rows[3].labels, rows[3].n_base) == ("gpl", "gpl,lgpl", 1)
    assert (rows[4].base_labels, rows[4].labels) == ("cc-by", "cc-by,cc-by-nc")
    assert (rows[5].n_base, rows[5].labels, rows[5].first_word, rows[5].score) == (0, "", None, 0.0)
    assert (rows[6].first_word, rows[6].n_words) == (1, 4) and rows[7].n_words == 0
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(none).count() == 0


def brute_top(ids, vectors, every, k):
    out = []
    for q, a in zip(ids, vectors):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in zip(ids, vectors) if v != q)[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(found)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    vectors = [[x + rng.gauss(0, 0.1) for x in rng.choice(base)] for _ in range(600)] + [[0.5] * 8] * 200 + [[1.0, 2.0], [3.0]]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([*rows, (900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8), (1100, [1e307] * 8), (None, [1.0])], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(256 * x)) for x in v] for v in vectors]
    want = brute_top([i for i, _ in rows], whole, 50, 5)
    assert sorted(map(tuple, topk.exact_top_k(df.withColumn("v", F.lit(1))).collect())) == want
    monkeypatch.setattr(topk, "GROUP_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    assert sorted(map(tuple, topk.exact_top_k(df).collect())) == want
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_vector_here_and_in_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (2, [2.0, 9.0]), (3, [2.0, 0.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.exact_top_k(df).collect()))
    assert got == [(0, 1, 2, 128 * 512), (0, 2, 3, 128 * 512), (0, 3, 1, 128 * 256)]
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/e/*.parquet')")
    assert sorted(duck.execute(topk.SQL).fetchall()) == got


def test_blocks_of_common_directions_are_skipped():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(64, 24)) * 256
    vid, of = np.arange(4096), rng.integers(0, 64, 4096)
    v = np.floor(centres[of] + rng.normal(size=(4096, 24)) * 12)
    found, scored, blocks = topk.search(vid[::50], v[::50], np.full(len(vid[::50]), -np.inf), vid, v)
    scores = v[::50] @ v.T
    for i, best in zip(range(0, 4096, 50), found):
        row = sorted((-int(s), int(c)) for s, c in zip(scores[i // 50], vid) if c != i)[:5]
        assert best == row
    assert scored < 0.15 * blocks  # a cluster has a 64th of the rows
    floor = np.array([-best[-1][0] for best in found], float)
    again, rescored, _ = topk.search(vid[::50], v[::50], floor, vid, v)
    assert again == found and rescored <= scored


def test_large_components_stay_exact():
    big = np.array([[2.0**40, 1.0], [2.0**40, -3.0], [1.0, 1.0]])
    got = topk.group_top_k(np.array([0]), big[:1], np.array([0, 1, 2]), big, 2)
    assert got.score.tolist() == [2**63 - 1, 2**40 + 1]
