import json
import hashlib

import pytest
from pyspark.sql import functions as F

from cadenza.operators import cache as K, route as R, signal as A, timeline as L
from cadenza.plans import queries as Q
from cadenza.sources import pages as S
from cadenza.streaming import intake


def test_roles_and_references(spark):
    script = spark.createDataFrame([(1, "quote", "q"), (1, "paragraph", "p"), (2, "quote", " "), (2, "list", "x"), (3, "quote", "only")], "doc_id long, block_type string, text string")
    roles = R.required_roles(script)
    assert {r.doc_id: r.roles for r in roles.collect()} == {1: ["narration", "quote"], 2: ["narration"], 3: ["quote"]}
    kept = {(r.doc_id, r.role): r.path for r in R.route_references(roles, "preserve", "a", "b").collect()}
    assert set(kept.values()) == {"a"}
    two = R.route_references(roles, "two_voice", "a", "b")
    assert {(r.doc_id, r.role): r.path for r in two.collect()} == {(1, "narration"): "a", (1, "quote"): "b", (2, "narration"): "a", (3, "quote"): "b"}
    assets = spark.createDataFrame([("a", "h", 800, 8000), ("b", "h", 0, 8000)], "path string, sha256 string, frames long, sample_rate int")
    valid = R.validate_references(two, assets)
    reasons = {(r.doc_id, r.role): r.reason for r in valid.collect()}
    assert reasons[1, "narration"] is None and "nothing" in reasons[1, "quote"]
    assert [r.doc_id for r in R.reject_identical_references(valid, "two_voice").collect()] == [1]
    assert R.reject_identical_references(valid, "preserve").count() == 0
    missing = R.validate_references(R.route_references(roles, "two_voice", None, "c"), assets)
    got = {(r.doc_id, r.role): r.reason for r in missing.collect()}
    assert "named" in got[1, "narration"] and "no such" in got[1, "quote"]


def test_role_settings(spark):
    rows = spark.createDataFrame([("quote",), ("list",), ("audio",)], "block_type string")
    got = {r.block_type: (r.role, r.extra_lead_pause_ms) for r in R.with_role(rows).collect()}
    assert got == {"quote": ("quote", 250), "list": ("narration", 0), "audio": (None, None)}
    with pytest.raises(Exception):
        R.with_role(rows, strict=True).collect()


def chunks(spark):
    return spark.createDataFrame([(1, 1, "narration", 'Él said "hi"'), (1, 2, "quote", "q"), (2, 1, "quote", "q")], "doc_id long, chunk_index int, role string, text string")


def models(spark, version="v1"):
    return spark.createDataFrame([(r, None, "english", 24000, version) for r in ("narration", "quote")], "role string, config string, language string, sample_rate int, version string")


def voices(spark):
    return spark.createDataFrame([(r, "a", "r", "p", "s" + r) for r in ("narration", "quote")], "role string, anchor_sha256 string, reference_audio_sha256 string, voice_state_payload_sha256 string, voice_state_sha256 string")


def test_keys_are_hashes_of_canonical_json(spark):
    keyed = K.payload_key(K.generation_payload(K.assign_seeds(chunks(spark)), models(spark), voices(spark)))
    for r in keyed.collect():
        assert r.payload_json == json.dumps(json.loads(r.payload_json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.cache_key == hashlib.sha256(r.payload_json.encode()).hexdigest() and r.file_stem == r.cache_key[:20]
        p = json.loads(r.payload_json)
        assert p["seed"] == 1234 + r.chunk_index and p["schema"] == 3 and p["generation"]["frames_after_eos"] is None and p["model"]["config"] is None
    keys = {(r.doc_id, r.chunk_index): r.cache_key for r in keyed.collect()}
    assert len(set(keys.values())) == 3
    other = K.payload_key(K.generation_payload(K.assign_seeds(chunks(spark)), models(spark, "v2"), voices(spark)))
    assert not set(keys.values()) & {r.cache_key for r in other.collect()}
    by_text = {r.seed for r in K.assign_seeds(chunks(spark), seed_by="text").filter("text = 'q'").collect()}
    assert len(by_text) == 1


def test_pending_work_is_asked_for_once(spark):
    same = K.assign_seeds(chunks(spark), seed_by="text")
    keyed = K.payload_key(K.generation_payload(same, models(spark), voices(spark)))
    none = spark.createDataFrame([], "file_stem string, payload_json string, wav_sha256 string, subtype string, channels int, rate int, actual_frames long, finite boolean, actual_sha256 string, frames long")
    todo = K.pending_work(K.classify_cache(keyed, none, 24000)).collect()
    assert sorted((r.doc_id, r.chunk_index, r.wanted_by) for r in todo) == [(1, 1, 1), (1, 2, 2)]


def test_upsert_takes_the_last_writer(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "cache_key string, created_utc int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 1, "new")], "cache_key string, created_utc int, v string")
    assert {r.cache_key: r.v for r in K.upsert_manifests(old, new).collect()} == {"a": "new", "b": "old", "c": "new"}


def signal(spark, *arrays):
    return A.explode_samples(spark.createDataFrame(list(enumerate(arrays)), "id int, samples array<float>"))


def test_activity_trim_and_fades(spark):
    loud = [0.0] * 10 + [0.5] * 10 + [0.0] * 12
    rows = signal(spark, loud, [0.0] * 8)
    act = A.detect_activity(rows, 1000, window_ms=4)
    assert [(r.id, r.start, r.end) for r in act.collect()] == [(0, 8, 20)]
    trimmed = A.trim_silence(rows, 1000, 2, 3, window_ms=4).orderBy("i").collect()
    assert len(trimmed) == 17 and trimmed[0].n == 17 and (trimmed[0].start, trimmed[0].end) == (2, 14)
    faded = [r.x for r in A.edge_fade(signal(spark, [1.0] * 9), 1000, 3).orderBy("i").collect()]
    assert faded == [0.0, 1.0, 1, 1, 1, 1, 1, 1.0, 0.0]
    one = [r.x for r in A.edge_fade(signal(spark, [1.0] * 4), 1000, 3).orderBy("i").collect()]
    assert one == [0.0, 1.0, 1.0, 1.0]


def test_documents_without_a_peak_are_named(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, -0.25), (2, 0.0), (3, 1.0), (3, float("nan")), (4, float("-inf")), (5, None)], "doc_id int, x double")
    assert {(r.doc_id, r.x) for r in A.normalize_peak(rows).collect()} == {(1, 0.95), (1, -0.475)}
    assert {r.doc_id: r.reason.split()[-1] for r in A.documents_without_peak(rows).collect()} == {2: "zero", 3: "infinite", 4: "infinite", 5: "samples"}


def test_anchor_has_hashes(spark):
    got = A.voice_anchor(signal(spark, [0.5, -1.0, 1.0, 0.25]), 1000, 0.002, 0.0).first()
    assert got.frames == 2 and got.source_sha256 == hashlib.sha256(b"16384,-32768,32767,8192").hexdigest() and got.anchor_sha256 == hashlib.sha256(b"16384,-32768").hexdigest()


def test_a_role_with_two_models_is_an_error(spark):
    with pytest.raises(Exception, match="more than one row"):
        K.generation_payload(K.assign_seeds(chunks(spark)), models(spark).union(models(spark, "v2")), voices(spark)).collect()


def test_quiet_cut(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=400).astype("float32")
    x[150:170] = 0.001
    sr, target, radius = 1000, 0.2, 0.1
    window, best = 20, (9e9, 0)
    for i in range(max(window, 100), min(400 - window, 300), window // 4):
        best = min(best, (float(np.sqrt(np.mean(x[i : i + window].astype("float64") ** 2))), i))
    got = A.quiet_cutpoint(signal(spark, x.tolist(), [0.1] * 10), sr, target, radius).orderBy("id").collect()
    assert [(r.n, r.cut) for r in got] == [(400, best[1]), (10, 10)]


def test_layout_has_no_overlap_and_joins_to_one_series(spark):
    c = spark.createDataFrame(
        [(1, 1, "paragraph", "narration", "Done.", True, 100, 10, 90), (1, 2, "quote", "quote", "so, ", False, 80, 0, 80), (1, 3, "paragraph", "narration", "End.", False, 60, 5, 50)],
        "doc_id long, chunk_index int, block_type string, role string, text string, paragraph_end boolean, n int, start int, end int",
    )
    placed = L.layout(c, 1000).orderBy("chunk_index").collect()
    assert [(r.target_ms, r.inserted) for r in placed] == [(950, 940), (400, 395), (None, None)]
    assert [(r.from_sample, r.to_sample) for r in placed] == [(690, 790), (1730, 1810), (2205, 2265)]
    samples = c.select("doc_id", "chunk_index", F.posexplode(F.array_repeat(F.lit(1.0), F.col("n"))).alias("i", "x"))
    joined = L.join_signals(samples, L.layout(c, 1000)).orderBy("i").collect()
    assert [r.i for r in joined] == list(range(2265)) and sum(r.x for r in joined) == 240


def test_numbers_follow_the_largest_in_use(spark):
    names = spark.createDataFrame([("narration_0003.wav",), ("Narration_0001.WAV",), ("other_9999.wav",), (None,)], "name string")
    docs = spark.range(5).select((F.col("id") * 7).alias("doc_id")).repartition(3)
    got = [(r.doc_id, r.number, r.name) for r in S.allocate_output_numbers(docs, names).orderBy("doc_id").collect()]
    assert got == [(0, 4, "narration_0004.wav"), (7, 5, "narration_0005.wav"), (14, 6, "narration_0006.wav"), (21, 7, "narration_0007.wav"), (28, 8, "narration_0008.wav")]
    big = spark.createDataFrame([("narration_12345.wav",)], "name string")
    assert S.allocate_output_numbers(docs.limit(1), big).first().name == "narration_12346.wav"
    assert S.allocate_output_numbers(docs.limit(0), big).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_every_id_gets_a_number_of_its_own(spark, adaptive):
    """Far more ids than the sample from which a sort draws its ranges."""
    names = spark.createDataFrame([("narration_0010.wav",)], "name string")
    n = 3_000_000
    docs = spark.range(0, n, 1, 12).select((F.xxhash64("id") % 10**12 * 8).alias("doc_id"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = S.allocate_output_numbers(docs, names)
        figures = got.agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number")).first()
        assert tuple(figures) == (n, n, 11, n + 10)
        ahead = got.groupBy(F.floor(F.col("number") / 1000).alias("k")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("k").collect()
        assert all(a.high <= b.low for a, b in zip(ahead, ahead[1:]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_text("<p>Hello</p>\n", encoding="utf-8")
    assert S.read_html_files(spark, str(tmp_path / "html")).first().html == "<p>Hello</p>\n"
    assert S.fingerprint_files(spark, str(tmp_path / "html")).first().sha256 == hashlib.sha256(b"<p>Hello</p>\n").hexdigest()
    good = json.dumps({"cache_key": "k", "payload_json": "{}", "frames": 3})
    (tmp_path / "m.json").write_text(good + "\n{broken\n", encoding="utf-8")
    assert [r.cache_key for r in S.read_manifests(spark, str(tmp_path / "m.json")).collect()] == ["k"]


def test_requests_and_stream(spark, tmp_path):
    ok, bad = intake.split_requests(spark.createDataFrame([(1, "hi"), (2, " "), (3, None)], "id int, text string"))
    assert [r.id for r in ok.collect()] == [1] and {r.id for r in bad.collect()} == {2, 3}
    source = str(tmp_path / "pages")
    schema = "page_id long, url string, html string"
    spark.createDataFrame([(1, "u", "<p>One. Two.</p>")], schema).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        intake.resume_stream(spark, stream, models(spark), voices(spark), str(tmp_path / "done"), str(tmp_path / "todo"), str(tmp_path / "ck"), str(tmp_path / "bad")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "todo")).collect()

    first = run()
    assert [r.text for r in first] == ["One. Two."]
    spark.createDataFrame([(1, "u", "<p>One. Two.</p>"), (5, "v", "<p>New.</p>"), (6, "w", f"<p>{'x' * 200}</p><p>fine</p>"), (7, "x", "")], schema).write.mode("append").parquet(source)
    assert sorted(r.text for r in run()) == ["New.", "One. Two."]
    assert sorted(r.text for r in run()) == ["New.", "One. Two."]  # nothing new
    bad = {r.doc_id: r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert set(bad) == {6, 7} and "budget" in bad[6] and "empty" in bad[7]


def test_keys_are_asked_for_once_over_batches_and_restarts(spark, tmp_path):
    """Keys are state: batches that come again, keys done before or in the same batch, and files of earlier batches that are gone."""
    row = lambda key, doc: (key, doc, 1, "quote", f"{key}{doc}", 0, "{}")
    wanted, done, out = (str(tmp_path / p) for p in ("wanted", "done", "out"))

    def run(rows, finished=()):
        spark.createDataFrame(rows, intake.ASKED).repartition(2).write.mode("append").parquet(wanted)
        spark.createDataFrame([(k,) for k in finished], "cache_key string").write.mode("append").parquet(done)
        todo = intake.new_keys(spark.readStream.schema(intake.ASKED).parquet(wanted), spark.readStream.schema("cache_key string").parquet(done))
        query = todo.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        return sorted((r.cache_key, r.doc_id) for r in spark.read.schema(intake.ASKED).parquet(out).collect())

    read = []
    assert run([row("a", 5), row("a", 2), row("b", 9), row("c", 1)], ["c"]) == [("a", 2), ("b", 9)]
    for f in (tmp_path / "wanted").glob("part-*"):
        f.unlink()
    assert run([row("a", 1), row("b", 9), row("d", 4)], ["e"]) == [("a", 2), ("b", 9), ("d", 4)]
    assert run([row("e", 1), row("c", 1), row("d", 4), row("f", None)]) == [("a", 2), ("b", 9), ("d", 4), ("f", None)]
    assert read == [5, 4, 4]  # what arrived, whatever came before


def test_flagship_has_one_paragraph_end_for_each_block(spark):
    rows = Q.QUERIES["flagship_plan"](spark, "/root/testdata/sf0.001")
    ends = rows.groupBy("doc_id", "block_index").agg(F.count_if(F.col("boundary") == "paragraph").alias("n")).filter("n <> 1")
    assert rows.count() > 0 and ends.count() == 0 and rows.filter("tokens > 44").count() == 0
