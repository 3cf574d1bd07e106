"""Content-addressed planning: seeds, payloads, keys, cache lookups, pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions import text as T
from cadenza.operators.route import ROLES

#: Fixed values of the payload's schema.
SEED, RAW_SCHEMA, VOICE_SCHEMA, ANCHOR_SECONDS, CUT = 1234, 3, 2, 15, "low_energy_20ms_v1"
TEMPERATURES = {"narration": 0.6, "quote": 0.85}
STEPS, EOS = 2, -4.0


def assign_seeds(chunks: DataFrame, overrides: DataFrame | None = None, base: int = SEED, seed_by: str = "position") -> DataFrame:
    """text_sha256 and seed: an override by the text's hash, else base + chunk_index (or, by ``text``, from the hash)."""
    if seed_by not in ("position", "text"):
        raise ValueError("seed_by must be 'position' or 'text'")
    rows = chunks.withColumn("text_sha256", F.sha2("text", 256))
    own = F.lit(base) + F.col("chunk_index") if seed_by == "position" else F.conv(F.substring("text_sha256", 1, 8), 16, 10)
    if overrides is not None:
        table = overrides.select("text_sha256", F.col("seed").alias("_seed")).dropDuplicates(["text_sha256"])
        rows = rows.join(table.hint("shuffle_merge"), "text_sha256", "left")
        own = F.coalesce("_seed", own)
    return rows.withColumn("seed", own.cast("long")).drop("_seed")


def generation_payload(chunks: DataFrame, models: DataFrame, voices: DataFrame) -> DataFrame:
    """``chunks`` with payload, a struct; payload_key() puts its fields in order.

    ``models``: role, config, language, sample_rate, version; ``voices``: role,
    anchor_sha256, reference_audio_sha256, voice_state_payload_sha256,
    voice_state_sha256; both have at most a row for each of the two roles.
    """
    model = models.select("role", F.struct("config", "language", "role", "sample_rate", _temperature(F.col("role")).alias("temp"), "version").alias("_model"))
    voice = voices.select("role", F.struct("anchor_sha256", "reference_audio_sha256", "voice_state_payload_sha256", "voice_state_sha256").alias("_voice"))
    rows = chunks.join(_by_role(model), "role").join(_by_role(voice), "role")
    generation = F.struct(
        F.lit(EOS).alias("eos_threshold"), F.lit(None).cast("int").alias("frames_after_eos"), F.lit(STEPS).alias("lsd_decode_steps"),
        F.lit(None).cast("double").alias("noise_clamp"), F.lit(False).alias("quantize"), _temperature(F.col("role")).alias("temperature"),
    )
    payload = F.struct(generation.alias("generation"), F.col("_model").alias("model"), "role", F.lit(RAW_SCHEMA).alias("schema"), "seed", "text", "text_sha256", F.col("_voice").alias("voice"))
    return rows.withColumn("payload", payload).drop("_model", "_voice")


def _by_role(table: DataFrame) -> DataFrame:
    """A table with at most a row for each of the two roles, to be sent to every task; more rows for one role are an error."""
    columns = [c for c in table.columns if c != "role"]
    one = table.filter(F.col("role").isin(*ROLES)).groupBy("role").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    single = F.when(F.col("_n") == 1, F.col("role")).otherwise(F.raise_error("a role has more than one row").cast("string"))
    return F.broadcast(one.select(single.alias("role"), *columns))


def _temperature(role: Column) -> Column:
    return F.when(role == "quote", F.lit(TEMPERATURES["quote"])).otherwise(F.lit(TEMPERATURES["narration"]))


def payload_key(df: DataFrame, payload: str = "payload", stem: int = 20) -> DataFrame:
    """payload_json, cache_key (its SHA-256) and file_stem, the key's first characters (20, voices: 16)."""
    rows = df.withColumn("payload_json", T.canonical_json(F.col(payload), df.schema[payload].dataType))
    return rows.withColumn("cache_key", F.sha2("payload_json", 256)).withColumn("file_stem", F.substring("cache_key", 1, stem))


def voice_identity(assets: DataFrame, models: DataFrame) -> DataFrame:
    """role, anchor_key, voice_key and voice_json; ``assets``: role, sha256 (of the recording), anchor_sha256."""
    anchor = F.struct(F.lit(ANCHOR_SECONDS).alias("anchor_seconds"), F.lit(CUT).alias("cut_algorithm"), F.col("sha256").alias("source_sha256"))
    model = F.struct("config", "language", "role", "sample_rate", _temperature(F.col("role")).alias("temp"), "version")
    state = F.struct(
        F.lit(CUT).alias("anchor_cut_algorithm"), F.lit(ANCHOR_SECONDS).alias("anchor_seconds_requested"), "anchor_sha256", model.alias("model"),
        F.lit(False).alias("quantize"), F.lit(VOICE_SCHEMA).alias("schema"),
    )
    rows = assets.join(_by_role(models), "role").withColumns({"_anchor": anchor, "_state": state})
    json = {c: T.canonical_json(F.col(c), rows.schema[c].dataType) for c in ("_anchor", "_state")}
    rows = rows.withColumn("voice_json", json["_state"])
    return rows.select("role", F.sha2(json["_anchor"], 256).alias("anchor_key"), F.sha2("voice_json", 256).alias("voice_key"), "voice_json")


def classify_cache(plan: DataFrame, manifests: DataFrame, sample_rate: int) -> DataFrame:
    """``plan`` with status: hit, miss, or the first reason to reject what the cache has.

    Joined on the file stem, as files are found; comparing payloads guards
    against two keys with one stem. ``manifests``: file_stem, payload_json,
    wav_sha256, frames, and the file's own subtype, channels, rate, actual_frames,
    actual_sha256, finite (null where it can't be read), as with_sounds() gives them,
    and unreadable, if there is such a column: why the file can't be read.
    """
    if "unreadable" not in manifests.columns:
        manifests = manifests.withColumn("unreadable", F.lit(None).cast("string"))
    kept = manifests.select("file_stem", *[F.col(c).alias(f"_{c}") for c in manifests.columns if c != "file_stem"])
    status = (
        F.when(F.col("_payload_json").isNull(), "miss")
        .when(F.col("_payload_json") != F.col("payload_json"), "the manifest is of another payload")
        .when(F.coalesce("_wav_sha256", F.lit("")) == "", "the manifest names no hash")
        .when(F.col("_unreadable").isNotNull(), F.concat(F.lit("the sound can't be read: "), F.col("_unreadable")))
        .when(~F.col("_subtype").eqNullSafe("FLOAT"), "the sound is not stored as floats")
        .when(~F.col("_channels").eqNullSafe(1), "the sound is not mono")
        .when(~F.col("_rate").eqNullSafe(sample_rate), "the sound has another rate")
        .when(F.coalesce("_actual_frames", F.lit(0)) <= 0, "the sound is empty")
        .when(~F.coalesce("_finite", F.lit(False)), "the sound has NaN or infinite samples")
        .when(~F.col("_actual_sha256").eqNullSafe(F.col("_wav_sha256")), "the file's hash is not the manifest's")
        .when(~F.col("_frames").eqNullSafe(F.col("_actual_frames")), "the file's length is not the manifest's")
        .otherwise("hit")
    )
    return plan.join(kept.hint("shuffle_merge"), "file_stem", "left").withColumn("status", status).drop(*[c for c in kept.columns if c != "file_stem"])


def with_sounds(manifests: DataFrame, sounds: DataFrame) -> DataFrame:
    """Manifests (file_stem, payload_json, wav_sha256, frames) with what wav.read_sounds() found in the files of their stems; those without a file are left out, as what they name is not there."""
    found = sounds.select(F.col("stem").alias("file_stem"), "subtype", "channels", "rate", F.col("frames").alias("actual_frames"), F.col("sha256").alias("actual_sha256"), "finite", F.col("reason").alias("unreadable"))
    return manifests.select("file_stem", "payload_json", "wav_sha256", "frames").join(found.hint("shuffle_merge"), "file_stem")


def classify_voice_cache(plan: DataFrame, manifests: DataFrame) -> DataFrame:
    """``plan`` (role, voice_json, voice_key) with status hit or rebuild; ``manifests``: file_stem, payload_json, state_sha256, actual_sha256."""
    kept = manifests.select("file_stem", F.col("payload_json").alias("_json"), F.col("state_sha256").alias("_want"), F.col("actual_sha256").alias("_have"))
    good = (F.col("_json") == F.col("voice_json")) & (F.col("_want") != "") & (F.col("_want") == F.col("_have"))
    rows = plan.withColumn("file_stem", F.substring("voice_key", 1, 16)).join(kept.hint("shuffle_merge"), "file_stem", "left")
    return rows.withColumn("status", F.when(good, "hit").otherwise("rebuild")).drop("_json", "_want", "_have")


def pending_work(classified: DataFrame) -> DataFrame:
    """What has to be made: all but hits, once for each key (the row that comes first in document order)."""
    first = F.min(F.struct("doc_id", "chunk_index")).alias("_first")
    todo = classified.filter("status <> 'hit'")
    return todo.groupBy("cache_key").agg(first, F.count("*").alias("wanted_by")).select("cache_key", F.col("_first.doc_id").alias("doc_id"), F.col("_first.chunk_index").alias("chunk_index"), "wanted_by")


def upsert_manifests(old: DataFrame, new: DataFrame, key: str = "cache_key", at: str = "created_utc") -> DataFrame:
    """The last written row of every key; at one instant a new row comes before an old one."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in (key, "_new")]
    last = F.max_by(F.struct(*columns), F.struct(at, "_new")).alias("_last")  # combined before the shuffle, as no sort would be
    return rows.groupBy(key).agg(last).select(key, "_last.*").select(*[c for c in rows.columns if c != "_new"])
