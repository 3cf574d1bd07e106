"""Packed signals, sound files, numbers that runs reserve."""

import hashlib
import io
import struct
import threading
import tracemalloc
import wave

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cadenza.operators import cache, packed, signal, timeline
from cadenza.sources import pages, shared, wav

SR = 1000


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, n in enumerate([0, 1, 3, 19, 20, 21, 150, 400, 401, 977]):
        x = rng.normal(size=n).astype("float32")
        x[: n // 3] *= 0.001
        x[-(n // 4) :] *= 0.0005 if n > 3 else 1
        rows.append((i, i % 3, SR, x.tolist()))
    return spark.createDataFrame(rows, "id long, doc_id long, sr int, samples array<float>").repartition(3).cache()


def same(left, right, *order):
    key = lambda r: tuple(r[c] for c in order)
    left, right = sorted(left.collect(), key=key), sorted(right.collect(), key=key)
    assert [r[0] for r in left] == [r[0] for r in right]
    for a, b in zip(left, right):
        a, b = a.asDict(), b.asDict()
        assert {k: v for k, v in a.items() if isinstance(v, str)} == {k: v for k, v in b.items() if isinstance(v, str)}
        assert {k: v for k, v in a.items() if not isinstance(v, str)} == pytest.approx({k: v for k, v in b.items() if not isinstance(v, str)}, rel=1e-9, abs=1e-12)


def test_packed_operators_equal_those_on_long_tables(signals):
    long = signal.explode_samples(signals)
    filled = signals.filter("size(samples) > 0")
    columns = ["id", "n", "w", "start", "size", "rms"]
    same(packed.rms_windows(filled, SR).select(columns), signal.rms_windows(long, SR).select(columns), "id", "w")
    same(packed.detect_activity(signals, SR, 0.5), signal.detect_activity(long, SR, 0.5).select("id", "n", "start", "end"), "id")
    trimmed = packed.trim_silence(signals, SR, 30, 10, 0.5)
    same(packed.explode_samples(trimmed, "id", "start", "end").select("id", "i", "x"), signal.trim_silence(long, SR, 30, 10, 0.5).select("id", "i", "x"), "id", "i")
    for ms in (0, 1, 4, 40, 5000):
        same(packed.explode_samples(packed.edge_fade(signals, SR, ms), "id"), signal.edge_fade(long, SR, ms).select("id", "i", "x"), "id", "i")
    same(packed.explode_samples(packed.render_chunks(signals, SR), "id"), signal.render_chunks(long, SR).select("id", "i", "x"), "id", "i")
    by_doc = signal.explode_samples(signals, ("id", "doc_id"))
    same(packed.explode_samples(packed.normalize_peak(signals), "id"), signal.normalize_peak(by_doc).select("id", "i", "x"), "id", "i")
    for target, radius in ((0.2, 0.1), (0.0, 0.5), (0.9, 0.05), (15.0, 1.5)):
        same(packed.quiet_cutpoint(filled, SR, target, radius), signal.quiet_cutpoint(long, SR, target, radius), "id")
    same(packed.voice_anchor(signals, SR, 0.2, 0.1), signal.voice_anchor(long, SR, 0.2, 0.1), "id")


def test_anchors_are_the_prefixes_that_are_hashed(signals):
    cut = {r.id: r.samples for r in packed.anchors(signals, SR, 0.2, 0.1).collect()}
    told = {r.id: r for r in packed.voice_anchor(signals, SR, 0.2, 0.1).collect()}
    assert cut.keys() == told.keys() and 0 not in cut
    for i, x in cut.items():
        assert told[i].frames == len(x) and packed.pcm_digests(np.array(x, "f4"), len(x))[0] == told[i].anchor_sha256


def test_odd_signals(spark):
    rows = [(1, None), (2, []), (3, [None, 0.5]), (4, [float("nan"), 1.0]), (5, [0.0] * 50)]
    df = spark.createDataFrame(rows, "id long, samples array<float>").withColumn("doc_id", F.col("id"))
    assert {r.id: r.start for r in packed.activity(df, SR).collect()} == dict.fromkeys(range(1, 6))
    assert packed.normalize_peak(df).count() == 0
    assert [r.id for r in packed.voice_anchor(df, SR, 0.01, 0.0).orderBy("id").collect()] == [3, 4, 5]
    assert {r.id: r.samples for r in packed.edge_fade(df, SR).collect()}[1] is None


def test_a_plan_of_packed_operators_shuffles_no_samples(spark):
    signals = spark.createDataFrame([(1, [0.5] * 40)], "id long, samples array<float>")
    for of in (packed.render_chunks, packed.quiet_cutpoint, packed.voice_anchor, packed.detect_activity):
        plan = of(signals, SR)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan


def test_digests_and_energies_hold_blocks_only():
    x = np.random.default_rng(0).normal(size=3_000_000).astype("float32") * 0.1
    tracemalloc.start()
    whole, anchor = packed.pcm_digests(x, 1_234_567)
    packed.rms(x, 480)
    packed.quiet_cut(x, 1_500_000, 480, 1_400_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    level = np.clip(np.sign(x * 32768.0) * np.floor(np.abs(x.astype("f8") * 32768) + 0.5), -32768, 32767).astype(int)
    assert whole == hashlib.sha256(",".join(map(str, level)).encode()).hexdigest()
    assert anchor == hashlib.sha256(",".join(map(str, level[:1_234_567])).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 900), st.integers(0, 900), st.integers(1, 40), st.integers(0, 400))
def test_the_quietest_window_is_the_one_of_the_definition(seed, n, target, width, radius):
    x = np.random.default_rng(seed).normal(size=n).astype("float32")
    low, high, best = max(width, target - radius), min(n - width, target + radius), (np.inf, target)
    for i in range(low, high, max(1, width // 4)):
        best = min(best, (float(np.sqrt(np.mean(x[i : i + width].astype("f8") ** 2))), i), key=lambda b: b[0])
    assert packed.quiet_cut(x, target, width, radius) == (min(target, n) if high <= low else best[1])


def pcm(samples, rate=SR, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def floats(samples, rate=SR):
    return wav.header(len(samples), rate) + np.array(samples, "<f4").tobytes()


def test_parsing_of_every_kind():
    got = wav.parse(floats([0.5, -1.0, 0.25]))
    assert (got["subtype"], got["channels"], got["rate"], got["frames"], got["finite"], got["reason"]) == ("FLOAT", 1, SR, 3, True, None) and got["samples"].tolist() == [0.5, -1.0, 0.25]
    for width, kind, raw in ((1, "PCM_U8", bytes([0, 128, 192])), (2, "PCM_16", struct.pack("<3h", -32768, 0, 16384)), (3, "PCM_24", b"\x00\x00\x80\x00\x00\x00\x00\x00\x40"), (4, "PCM_32", struct.pack("<3i", -(2**31), 0, 2**30))):
        got = wav.parse(pcm(raw, width=width))
        assert got["subtype"] == kind and got["samples"].tolist() == [-1.0, 0.0, 0.5]
    two = wav.parse(pcm(struct.pack("<4h", 16384, 0, -16384, -16384), channels=2))
    assert two["channels"] == 2 and two["frames"] == 2 and two["samples"].tolist() == [0.25, -0.5]
    with wave.open(io.BytesIO(pcm(b"\x00\x40" * 5)), "rb") as f:
        assert f.getnframes() == wav.parse(pcm(b"\x00\x40" * 5))["frames"] == 5


BAD = {
    "no RIFF/WAVE": b"hello, this is no sound", "no RIFF": b"", "ends within": floats([0.1] * 50)[:-10], "no format": b"RIFF\x04\x00\x00\x00WAVE", "not known": floats([0.1]).replace(struct.pack("<HH", 3, 1), struct.pack("<HH", 77, 1), 1),
    "no samples": floats([])[:-8], "whole frames": pcm(b"\x00\x01" * 3).replace(struct.pack("<HHIIHH", 1, 1, SR, 2 * SR, 2, 16), struct.pack("<HHIIHH", 1, 2, SR, 4 * SR, 4, 16)),
}


@pytest.mark.parametrize("said", BAD)
def test_damaged_files_give_a_reason(said):
    got = wav.parse(BAD[said])
    assert said in got["reason"] and got["samples"] is None


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 80), st.binary(max_size=6))
def test_no_damage_is_a_crash(at, put):
    raw = pcm(b"\x01\x02" * 12, channels=2)
    got = wav.parse(raw[:at] + put + raw[at + len(put) :])
    assert (got["samples"] is None) == (got["reason"] is not None)


def test_every_reason_of_the_cache_is_reached_by_a_file(spark, tmp_path):
    good = floats([0.1, 0.2])
    stereo = wav.header(2, SR).replace(struct.pack("<HHIIHH", 3, 1, SR, 4 * SR, 4, 32), struct.pack("<HHIIHH", 3, 2, SR, 8 * SR, 8, 32)) + np.zeros(4, "<f4").tobytes()
    files = {"hit": good, "payload": good, "unnamed": good, "broken": good[:-3], "pcm": pcm(b"\x00\x01" * 2), "stereo": stereo, "rate": floats([0.1], 44100), "empty": floats([]), "nan": floats([0.1, float("nan")]), "hash": good, "frames": good}
    for stem, raw in files.items():
        (tmp_path / f"{stem}.wav").write_bytes(raw)
    sounds = wav.read_sounds(spark, str(tmp_path))
    assert {r.stem: r.sha256 for r in sounds.collect()} == {s: hashlib.sha256(raw).hexdigest() for s, raw in files.items()}
    stems = [*files, "gone"]
    sha = {s: hashlib.sha256(files.get(s, b"")).hexdigest() for s in stems} | {"unnamed": "", "hash": "x"}
    frames = {s: 2 for s in stems} | {"frames": 3, "rate": 1, "empty": 0}
    manifests = spark.createDataFrame([(s, "{}" if s == "payload" else f"p{s}", sha[s], frames[s]) for s in stems], "file_stem string, payload_json string, wav_sha256 string, frames long")
    plan = spark.createDataFrame([(s, f"p{s}") for s in [*stems, "never"]], "file_stem string, payload_json string")
    got = {r.file_stem: r.status for r in cache.classify_cache(plan, cache.with_sounds(manifests, sounds), SR).collect()}
    words = {"hit": "hit", "payload": "another payload", "unnamed": "no hash", "broken": "can't be read: the file ends", "pcm": "not stored as floats", "stereo": "not mono", "rate": "another rate", "empty": "empty", "nan": "NaN", "hash": "hash is not", "frames": "length is not", "gone": "miss", "never": "miss"}
    assert got.keys() == words.keys() and all(words[s] in got[s] for s in words), got


def test_recordings_read_back_as_they_were_joined(spark, tmp_path):
    rows = [(1, 1, "paragraph", "narration", "Done.", True, 100, 10, 90), (1, 2, "quote", "quote", "so, ", False, 80, 0, 80), (1, 3, "paragraph", "narration", "End.", False, 60, 5, 50), (2, 1, "paragraph", "narration", "One.", True, 30, 0, 30)]
    c = spark.createDataFrame(rows, "doc_id long, chunk_index int, block_type string, role string, text string, paragraph_end boolean, n int, start int, end int")
    placed = timeline.layout(c, SR)
    signals = c.select("doc_id", "chunk_index", F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: (k / 1000).cast("float")).alias("samples"))
    pieces = packed.join_signals(signals, placed)
    long = timeline.join_signals(signals.select("doc_id", "chunk_index", F.posexplode("samples").alias("i", "x")), placed)
    want = {d: [r.x for r in long.filter(F.col("doc_id") == d).orderBy("i").collect()] for d in (1, 2)}
    names = spark.createDataFrame([(1, "narration_0001.wav"), (2, "narration_0002.wav")], "doc_id long, name string")
    folder = f"file://{tmp_path}/out"
    made = {r.name: r for r in wav.write_sounds(pieces.repartition(3), names, SR, folder).collect()}
    found = {r.stem + ".wav": r for r in wav.read_sounds(spark, folder).collect()}
    assert made.keys() == found.keys() == {"narration_0001.wav", "narration_0002.wav"} and len(list((tmp_path / "out").iterdir())) == 2
    for name, r in found.items():
        d = made[name].doc_id
        assert r.samples == pytest.approx(want[d]) and r.frames == made[name].frames == len(want[d]) and r.sha256 == made[name].sha256 and (r.subtype, r.rate, r.channels) == ("FLOAT", SR, 1)


def test_runs_that_number_at_once_get_numbers_of_their_own(spark, tmp_path):
    folder, got = f"{tmp_path}/outputs", []

    def run(k):
        for n in range(5):
            count = 1 + (k + n) % 4
            got.append((pages.reserve_numbers(spark, folder, count, taken=10), count))

    threads = [threading.Thread(target=run, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    numbers = sorted(first + i for first, count in got for i in range(count))
    assert numbers == list(range(11, 11 + sum(c for _, c in got)))
    docs, names = spark.range(3).withColumnRenamed("id", "doc_id"), spark.createDataFrame([("narration_0010.wav",)], "name string")
    one, two = (pages.allocate_output_numbers(docs, names, folder=folder).collect() for _ in range(2))
    assert [r.number for r in sorted([*one, *two])] and sorted(r.number for r in [*one, *two]) == list(range(numbers[-1] + 1, numbers[-1] + 7))
    assert not shared.put_if_absent(spark, f"{folder}/.numbers/claim-11", "9") and "9" != shared.content(spark, f"{folder}/.numbers/claim-11")
