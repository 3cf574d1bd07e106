"""Inputs that the registered queries share, each with its SQL twin: the given tables seen as posts, blocks, signals, assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.operators import cache, chunk, extract, route, script, signal
from cadenza.sources import pages as S

SR = 250  # of the embeddings taken as signals of 64 samples
LOUD = 0.12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_pages(spark, f"{sf_dir}/pages.parquet")


def guest(c: str) -> F.Column:
    return F.concat(F.lit("Guest "), F.char((F.lit(65) + F.col(c) % 26).cast("int")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as blocks: system heads, the assistant writes paragraphs, the user is quoted (two of three by name)."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "assistant", "paragraph").otherwise("quote")
    named = (F.col("role") == "user") & (F.col("conv_id") % 3 != 0)
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), kind.alias("type"), F.lit(None).cast("int").alias("level"), F.when(named, guest("conv_id")).alias("speaker"), "text")


def quoted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post for every turn: a card, then the turn as an attributed quotation in two paragraphs."""
    t = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit('<div class="x kg-card"><p>'), safe, F.lit("</p></div><blockquote><p>“"), safe, F.lit("”</p><p>— "), guest("conv_id"), F.lit("</p></blockquote>"))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), html.alias("html"))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.build_script(turns(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.build_role_chunks(told(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    return e.select(F.col("vec_id").alias("id"), F.lit(SR).alias("sr"), F.col("embedding").alias("samples"), "label")


def sound_name(c: str) -> F.Column:
    return F.concat(F.lit("sound_"), F.col(c).cast("string"), F.lit(".wav"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.explode_samples(signals(spark, sf_dir))


def sounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a signal whose length and activity follow from their text and place."""
    i, n = F.col("chunk_index"), F.char_length("text") * 20
    return chunks(spark, sf_dir).withColumns({"n": n, "start": (i % 5) * 10, "end": n - (i % 3) * 7})


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording for every supplier: some are empty, some have another's content."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("voice_"), F.col("s_suppkey").cast("string")).alias("path"), F.sha2((F.col("s_suppkey") % 7).cast("string"), 256).alias("sha256"),
        F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(F.col("s_suppkey") * 100).cast("bigint").alias("frames"), F.lit(8000).alias("sample_rate"),
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, role, path: every document has recordings of its own."""
    r = script_roles(spark, sf_dir).select("doc_id", F.explode("roles").alias("role"))
    number = F.when(F.col("role") == "quote", F.col("doc_id") * 3 % 13).otherwise(F.col("doc_id") % 11)
    return r.withColumn("path", F.when(F.col("doc_id") % 17 != 0, F.concat(F.lit("voice_"), number.cast("string"))))


def script_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.required_roles(told(spark, sf_dir))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each role, told apart by figures of the region table."""
    r = table(spark, sf_dir, "region")
    rows = r.filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "narration").otherwise("quote").alias("role"), F.col("r_name").alias("version"))
    return rows.select("role", F.lit("default").alias("config"), F.lit("english").alias("language"), F.lit(24000).alias("sample_rate"), "version")


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda s: F.sha2(F.concat("version", F.lit(s)), 256)
    return models(spark, sf_dir).select("role", h("a").alias("anchor_sha256"), h("r").alias("reference_audio_sha256"), h("p").alias("voice_state_payload_sha256"), h("s").alias("voice_state_sha256"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.payload_key(cache.generation_payload(cache.assign_seeds(chunks(spark, sf_dir)), models(spark, sf_dir), voices(spark, sf_dir)))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache would hold after an earlier run: four of five chunks, some of them damaged in one way or another."""
    k = keyed(spark, sf_dir).filter("chunk_index % 5 <> 0").dropDuplicates(["cache_key"])
    m = F.pmod(F.char_length("text"), F.lit(11))
    frames = F.char_length("text").cast("bigint") * 100
    return k.select(
        "file_stem", F.when(m == 1, F.lit("{}")).otherwise(F.col("payload_json")).alias("payload_json"), F.when(m == 2, "").otherwise(F.col("cache_key")).alias("wav_sha256"),
        F.when(m == 3, "PCM_16").otherwise("FLOAT").alias("subtype"), F.when(m == 4, 2).otherwise(1).alias("channels"), F.when(m == 5, 22050).otherwise(24000).alias("rate"),
        F.when(m == 6, 0).otherwise(frames).cast("bigint").alias("actual_frames"), (m != 7).alias("finite"), F.when(m == 8, "x").otherwise(F.col("cache_key")).alias("actual_sha256"),
        F.when(m == 9, frames + 1).otherwise(frames).cast("bigint").alias("frames"),
    )


# The SQL twins. Strings to put into WITH clauses; names follow the functions above.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def blank_sql(x: str) -> str:
    return f"NOT regexp_matches(coalesce({x}, ''), '[^{WS[1:]}')"


def tokens_sql(x: str) -> str:
    return f"greatest(1, (length({x}) + 3) // 4)"


def sentences_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({norm_sql(x)}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def clauses_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '([,;:\\-–—]) +', '\\1' || chr(1), 'g'), chr(1)), lambda c: c <> '')"


def words_sql(x: str) -> str:
    return f"len(string_split({x}, ' '))"


def pack_sql(units: str, budget: int, tokens=tokens_sql) -> str:
    joined = "CASE WHEN st.now = '' THEN u ELSE st.now || ' ' || u END"
    fits = f"{tokens(joined)} <= {budget}"
    fold = (
        f"list_reduce({units}, lambda st, u: {{'done': CASE WHEN {fits} OR st.now = '' THEN st.done ELSE list_append(st.done, st.now) END, "
        f"'now': CASE WHEN {fits} THEN {joined} ELSE u END}}, {{'done': []::VARCHAR[], 'now': ''}})"
    )
    return f"list_transform([{fold}], lambda r: CASE WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END)[1]"


def units_sql(x: str, budget: int, tokens=tokens_sql) -> str:
    of_clause = f"CASE WHEN {tokens('c')} <= {budget} THEN [c] ELSE {pack_sql('''list_filter(string_split(c, ' '), lambda z: z <> '')''', budget, tokens)} END"
    return f"flatten(list_transform({sentences_sql(x)}, lambda q: CASE WHEN {tokens('q')} <= {budget} THEN [q] ELSE flatten(list_transform({clauses_sql('q')}, lambda c: {of_clause})) END))"


TURNS = """turns AS (
  SELECT conv_id AS doc_id, turn AS pos, CASE role WHEN 'system' THEN 'heading' WHEN 'assistant' THEN 'paragraph' ELSE 'quote' END AS type, NULL::INTEGER AS level,
         CASE WHEN role = 'user' AND conv_id % 3 <> 0 THEN 'Guest ' || chr((65 + conv_id % 26)::INTEGER) END AS speaker, text FROM conversations)"""


def script_sql(mode: str = "preserve", source: str = "turns", to: str = "script") -> str:
    drop = " AND type <> 'quote'" if mode == "exclude" else ""
    return f"""{to}_k AS (SELECT doc_id, pos, type, CASE WHEN type = 'quote' THEN speaker END AS speaker, text FROM {source} WHERE type IN ('paragraph', 'heading', 'list', 'quote') AND NOT ({blank_sql('text')}){drop}),
{to}_n AS (SELECT *, sum(CASE WHEN type = 'quote' AND coalesce(speaker, '') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nth, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM {to}_k),
{to} AS (SELECT doc_id, i::INTEGER AS block_index, type AS block_type, CASE WHEN type = 'quote' AND coalesce(speaker, '') <> '' THEN speaker || ' ' || (['says', 'shares', 'reflects', 'feels'])[((nth - 1) % 4 + 1)::INTEGER] || ', "' || text || '"' ELSE text END AS text, speaker FROM {to}_n)"""


def chunks_sql(budget: int = chunk.BUDGET, source: str = "script", to: str = "chunks") -> str:
    return f"""{to}_u AS (SELECT *, {units_sql('text', budget)} AS u FROM {source} WHERE NOT ({blank_sql('text')})),
{to}_p AS (SELECT * EXCLUDE (u, text), {pack_sql('u', budget)} AS c FROM {to}_u),
{to}_f AS (SELECT *, max(CASE WHEN len(list_filter(c, lambda x: {tokens_sql('x')} > {budget})) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS faulty FROM {to}_p),
{to}_e AS (SELECT * EXCLUDE (c, faulty), len(c) AS n, unnest(c) AS text, unnest(range(0, len(c)))::INTEGER AS part FROM {to}_f WHERE faulty = 0),
{to} AS (SELECT doc_id, block_index, part, text, part = n - 1 AS paragraph_end, block_type, speaker, CASE WHEN block_type = 'quote' THEN 'quote' ELSE 'narration' END AS role,
           row_number() OVER (PARTITION BY doc_id ORDER BY block_index, part)::INTEGER AS chunk_index FROM {to}_e)"""


CHUNKS = f"{TURNS}, {script_sql()}, {chunks_sql()}"
SIGNALS = f"""samples AS (SELECT vec_id AS id, len(embedding)::INTEGER AS n, (unnest(range(0, len(embedding))))::INTEGER AS i, unnest(embedding)::DOUBLE AS x, label FROM embeddings WHERE embedding IS NOT NULL)"""
SOUNDING = CHUNKS + ", sounding AS (SELECT *, (length(text) * 20)::INTEGER AS n, ((chunk_index % 5) * 10)::INTEGER AS start, (length(text) * 20 - (chunk_index % 3) * 7)::INTEGER AS \"end\" FROM chunks)"
ASSETS = """assets AS (SELECT 'voice_' || s_suppkey AS path, sha256((s_suppkey % 7)::VARCHAR) AS sha256, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey * 100 END::BIGINT AS frames, 8000 AS sample_rate FROM supplier)"""
ROLES = f"{TURNS}, {script_sql()}, roles AS (SELECT doc_id, list_filter(['narration', 'quote'], lambda r: list_contains(list(DISTINCT CASE WHEN block_type = 'quote' THEN 'quote' ELSE 'narration' END), r)) AS roles FROM script GROUP BY doc_id)"
ROUTED = ROLES + ", routed AS (SELECT doc_id, role, CASE WHEN doc_id % 17 <> 0 THEN 'voice_' || CASE WHEN role = 'quote' THEN doc_id * 3 % 13 ELSE doc_id % 11 END END AS path FROM (SELECT doc_id, unnest(roles) AS role FROM roles))"
MODELS = """models AS (SELECT CASE r_regionkey WHEN 0 THEN 'narration' ELSE 'quote' END AS role, r_name AS version FROM region WHERE r_regionkey < 2)"""
_T = "CASE role WHEN 'quote' THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END"
MODEL_SQL = f"{{'config': 'default', 'language': 'english', 'role': role, 'sample_rate': 24000, 'temp': {_T}, 'version': version}}"
KEYED = (
    CHUNKS
    + f""", {MODELS}, seeded AS (SELECT *, sha256(text) AS text_sha256, (1234 + chunk_index)::BIGINT AS seed FROM chunks),
keyed_p AS (SELECT seeded.*, to_json({{'generation': {{'eos_threshold': -4.0::DOUBLE, 'frames_after_eos': NULL, 'lsd_decode_steps': 2, 'noise_clamp': NULL, 'quantize': false, 'temperature': {_T}}},
  'model': {MODEL_SQL}, 'role': role, 'schema': 3, 'seed': seed, 'text': text, 'text_sha256': text_sha256,
  'voice': {{'anchor_sha256': sha256(version || 'a'), 'reference_audio_sha256': sha256(version || 'r'), 'voice_state_payload_sha256': sha256(version || 'p'), 'voice_state_sha256': sha256(version || 's')}}}})::VARCHAR AS payload_json
  FROM seeded JOIN models USING (role)),
keyed AS (SELECT *, sha256(payload_json) AS cache_key, left(sha256(payload_json), 20) AS file_stem FROM keyed_p)"""
)
MANIFESTS = (
    KEYED
    + """, man_k AS (SELECT DISTINCT ON (cache_key) *, length(text) % 11 AS m, (length(text) * 100)::BIGINT AS fr FROM keyed WHERE chunk_index % 5 <> 0),
manifests AS (SELECT file_stem, CASE WHEN m = 1 THEN '{}' ELSE payload_json END AS payload_json, CASE WHEN m = 2 THEN '' ELSE cache_key END AS wav_sha256, CASE WHEN m = 3 THEN 'PCM_16' ELSE 'FLOAT' END AS subtype,
  CASE WHEN m = 4 THEN 2 ELSE 1 END AS channels, CASE WHEN m = 5 THEN 22050 ELSE 24000 END AS rate, CASE WHEN m = 6 THEN 0 ELSE fr END AS actual_frames, m <> 7 AS finite, CASE WHEN m = 8 THEN 'x' ELSE cache_key END AS actual_sha256,
  CASE WHEN m = 9 THEN fr + 1 ELSE fr END AS frames FROM man_k),
classified AS (SELECT k.*, CASE WHEN m.payload_json IS NULL THEN 'miss' WHEN m.payload_json <> k.payload_json THEN 'the manifest is of another payload' WHEN m.wav_sha256 = '' THEN 'the manifest names no hash'
  WHEN m.subtype <> 'FLOAT' THEN 'the sound is not stored as floats' WHEN m.channels <> 1 THEN 'the sound is not mono' WHEN m.rate <> 24000 THEN 'the sound has another rate' WHEN m.actual_frames <= 0 THEN 'the sound is empty'
  WHEN NOT m.finite THEN 'the sound has NaN or infinite samples' WHEN m.actual_sha256 <> m.wav_sha256 THEN 'the file''s hash is not the manifest''s' WHEN m.frames <> m.actual_frames THEN 'the file''s length is not the manifest''s' ELSE 'hit' END AS status
  FROM keyed k LEFT JOIN manifests m USING (file_stem))"""
)
_SEG = r"""(?is)(<!--.*?-->|<[!?][^>]*>?|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<)([^<]*)"""
_DECODED = "regexp_replace(replace(replace(replace(txt, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
SEGMENTS = rf"""seg_a AS (SELECT page_id AS doc_id, regexp_extract_all(html, '{_SEG}', 1) AS tags, regexp_extract_all(html, '{_SEG}', 2) AS txts FROM pages),
seg_b AS (SELECT doc_id, unnest(range(0, len(tags)))::INTEGER AS seg, unnest(tags) AS tag, unnest(txts) AS txt FROM seg_a),
seg_c AS (SELECT doc_id, seg, tag, CASE WHEN tag = '<' THEN '<' || txt ELSE txt END AS txt, lower(regexp_extract(tag, '^</?([a-zA-Z][^\s/>]*)', 1)) AS name FROM seg_b),
segments AS (SELECT doc_id, seg, CASE WHEN tag = '<' THEN 'text' WHEN regexp_matches(tag, '^<[!?]') OR (name IN ('script', 'style') AND tag NOT LIKE '</%') THEN 'skip' WHEN tag LIKE '</%' THEN 'close' ELSE 'open' END AS kind, name,
  {_DECODED} AS txt FROM seg_c)"""
#: The pages' paragraphs nest only in each other and in one article, so a running depth finds their blocks.
PAGE_BLOCKS = SEGMENTS + f""", art AS (SELECT doc_id, coalesce(min(seg) FILTER (WHERE kind = 'close' AND name = 'article'), 2147483647) AS stop FROM segments GROUP BY doc_id),
dep AS (SELECT s.*, sum(CASE WHEN name = 'p' AND kind = 'open' THEN 1 WHEN name = 'p' AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg) AS d FROM segments s JOIN art USING (doc_id) WHERE seg < stop),
rooted AS (SELECT *, max(CASE WHEN kind = 'open' AND (name = 'h1' OR name = 'p' AND d = 1) THEN seg END) OVER (PARTITION BY doc_id ORDER BY seg) AS root,
  max(CASE WHEN kind = 'close' AND name = 'h1' THEN seg END) OVER (PARTITION BY doc_id ORDER BY seg) AS shut FROM dep),
pieces AS (SELECT doc_id, root, seg, CASE WHEN d > 0 THEN 'paragraph' ELSE 'heading' END AS type, CASE WHEN name IN ('p', 'br') THEN ' ' ELSE '' END || txt AS txt FROM rooted WHERE d > 0 OR (root IS NOT NULL AND (shut IS NULL OR shut < root) AND name = 'h1')),
texts AS (SELECT doc_id, root, type, {norm_sql("string_agg(txt, '' ORDER BY seg)")} AS text FROM pieces GROUP BY ALL),
page_blocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY root) - 1)::INTEGER AS pos, type, CASE type WHEN 'heading' THEN 1 END::INTEGER AS level, NULL::VARCHAR AS speaker, text, root FROM texts WHERE text <> '')"""
