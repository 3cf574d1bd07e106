"""The registered queries of the library's own operators, each with its SQL twin (None where SQL can't say it).

A query applies one operator to the whole of a given table, or to what
``inputs`` derives from one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cadenza.functions import text as T
from cadenza.operators import cache, chunk, extract, packed, route, script, signal, timeline
from cadenza.plans import inputs as I
from cadenza.sources import pages as S, wav
from cadenza.sources.manifests import ManifestTable
from cadenza.sources.shared import shared_path, written
from cadenza.streaming import intake

RULES = (("the", "thee"), ("to", "too"), ("en", "enn"))
R6 = lambda c: F.round(c, 6)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return put


# Sources and sinks


@query("s1_read_pages", "SELECT page_id, url, html FROM pages")
def _(spark, d):
    return I.pages(spark, d)


@query("s2_split_empty_documents", f"SELECT page_id, page_id % 9 = 0 OR {I.blank_sql('html')} AS rejected FROM pages")
def _(spark, d):
    """Every ninth page is made blank."""
    blank = F.when(F.col("page_id") % 9 == 0, " \n\u3000").otherwise(F.col("html"))
    ok, bad = extract.split_empty_documents(I.pages(spark, d).withColumn("html", blank))
    return ok.select("page_id", F.lit(False).alias("rejected")).unionByName(bad.select("page_id", F.lit(True).alias("rejected")))


@query("s3_fingerprint", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def _(spark, d):
    return S.fingerprint(I.pages(spark, d), "html").select("page_id", "sha256")


@query("s4_s5_manifests_round_trip", "WITH " + I.KEYED + " SELECT DISTINCT cache_key, payload_json, cache_key AS wav_sha256 FROM keyed")
def _(spark, d):
    path = shared_path(spark, "manifests")
    rows = I.keyed(spark, d).select("cache_key", "payload_json").distinct()
    S.write_manifests(rows.withColumn("wav_sha256", F.col("cache_key")), path)
    return S.read_manifests(spark, path).select("cache_key", "payload_json", "wav_sha256")


@query("s6_write_plan", "WITH " + I.CHUNKS + " SELECT doc_id, chunk_index, role, text FROM chunks")
def _(spark, d):
    path = shared_path(spark, "plan")
    S.write_plan(I.chunks(spark, d).select("doc_id", "chunk_index", "role", "text"), path)
    return spark.read.parquet(path).select("doc_id", "chunk_index", F.col("role").cast("string").alias("role"), "text")


@query("s6_write_sounds", f"SELECT 'sound_' || vec_id AS stem, 'FLOAT' AS subtype, 1 AS channels, {I.SR} AS rate, len(embedding)::BIGINT AS frames, true AS finite, true AS same FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, d):
    """Every signal as a recording: written as files and read back."""
    s = I.signals(spark, d)
    folder = shared_path(spark, "sounds")
    wav.write_sounds(s.select(F.col("id").alias("doc_id"), F.lit(0).alias("from_sample"), "samples"), s.select(F.col("id").alias("doc_id"), I.sound_name("id").alias("name")), I.SR, folder)
    found = wav.read_sounds(spark, folder)
    own = s.select(F.regexp_replace(I.sound_name("id"), ".wav$", "").alias("stem"), F.col("samples").alias("given"))
    return found.join(own.hint("shuffle_merge"), "stem").select("stem", "subtype", "channels", "rate", "frames", "finite", (F.col("samples") == F.col("given")).alias("same"))


@query("s7_allocate_output_numbers", """SELECT page_id AS doc_id, n AS number, 'narration_' || CASE WHEN length(n::VARCHAR) < 4 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END || '.wav' AS name
FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) + (SELECT coalesce(max(s_suppkey), 0) FROM supplier) AS n FROM pages)""")
def _(spark, d):
    names = I.table(spark, d, "supplier").select(F.concat(F.lit("Narration_"), S.padded("s_suppkey"), F.lit(".WAV")).alias("name"))
    return S.allocate_output_numbers(I.pages(spark, d).withColumnRenamed("page_id", "doc_id"), names)


# HTML to blocks


@query("x1_html_segments", f"WITH {I.SEGMENTS} SELECT doc_id, seg, kind, name, txt FROM segments")
def _(spark, d):
    return extract.html_segments(I.pages(spark, d)).select("doc_id", "seg", "kind", "name", "txt")


@query("x2_open_paths", f"WITH {I.PAGE_BLOCKS} SELECT doc_id, seg, root, type FROM pieces WHERE txt NOT IN ('', ' ')")
def _(spark, d):
    """The paths of text that is heard, and the outermost block in each."""
    heard = extract.open_paths(I.pages(spark, d)).filter(~F.exists("path", lambda e: e["name"].isin(*extract.SILENT) | e["card"]))
    block = F.get(F.filter("path", lambda e: e["name"].isin(*extract.BLOCKS)), F.lit(0))
    rows = heard.withColumn("block", block).filter("block IS NOT NULL")
    return rows.select("doc_id", "seg", F.col("block.seg").alias("root"), F.when(F.col("block.name") == "p", "paragraph").otherwise("heading").alias("type"))


@query("x3_drop_skipped_subtrees", f"WITH {I.PAGE_BLOCKS} SELECT doc_id, count(*) AS runs, sum(length(txt) - (name IN ('p', 'br'))::INTEGER)::BIGINT AS chars FROM (SELECT p.*, s.name FROM pieces p JOIN segments s USING (doc_id, seg)) WHERE txt NOT IN ('', ' ') GROUP BY doc_id")
def _(spark, d):
    items = extract.visible_items(I.pages(spark, d)).filter(F.col("txt") != extract.BREAK)
    return items.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.char_length("txt")).alias("chars"))


@query("x4_drop_cards", f"""SELECT conv_id * 1000 + turn AS doc_id, 0 AS pos, 'quote' AS type, 'Guest ' || chr((65 + conv_id % 26)::INTEGER) AS speaker, trim({I.norm_sql('text')}, '"''“”‘’') AS text
FROM conversations WHERE trim({I.norm_sql('text')}, '"''“”‘’') <> ''""")
def _(spark, d):
    return extract.extract_blocks(I.quoted_pages(spark, d)).select("doc_id", "pos", "type", "speaker", "text")


@query("x5_assign_block_root", f"WITH {I.PAGE_BLOCKS} SELECT doc_id, root, type, count(*) AS runs FROM pieces WHERE txt NOT IN ('', ' ') GROUP BY ALL")
def _(spark, d):
    items = extract.visible_items(I.pages(spark, d)).filter(F.col("txt") != extract.BREAK)
    return items.groupBy("doc_id", "root", F.when(F.col("root_name") == "p", "paragraph").otherwise("heading").alias("type")).agg(F.count("*").alias("runs"))


@query("x6_text_with_breaks", f"WITH {I.PAGE_BLOCKS} SELECT doc_id, root, type, text FROM texts")
def _(spark, d):
    texts = extract.block_texts(extract.visible_items(I.pages(spark, d)))
    return texts.select("doc_id", "root", F.when(F.col("root_name") == "p", "paragraph").otherwise("heading").alias("type"), T.normalize_ws(F.col("raw")).alias("text"))


@query("x7_normalize_ws", f"SELECT doc_id, {I.norm_sql('text')} AS text FROM documents")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", T.normalize_ws(F.col("text")).alias("text"))


@query("x8_heading_blocks", f"WITH {I.PAGE_BLOCKS} SELECT doc_id, root, level, text FROM page_blocks WHERE type = 'heading'")
def _(spark, d):
    return extract.heading_blocks(extract.block_texts(extract.visible_items(I.pages(spark, d))))


@query("x9_paragraph_blocks", f"WITH {I.PAGE_BLOCKS} SELECT doc_id, root, text FROM page_blocks WHERE type = 'paragraph'")
def _(spark, d):
    return extract.paragraph_blocks(extract.block_texts(extract.visible_items(I.pages(spark, d))))


@query("x10_is_speaker_name", r"""WITH n AS (SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT -n_nationkey - 1, n_name FROM nation)
SELECT id, name, regexp_matches(name, '^\p{L}[\p{L}\p{M} .''’\-]{0,79}$') AS is_name FROM n""")
def _(spark, d):
    n = I.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    n = n.unionByName(I.table(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("bigint").alias("id"), F.col("n_name").alias("name")))
    return n.withColumn("is_name", T.is_speaker_name(F.col("name")))


@query("x11_split_attribution", f"""SELECT conv_id, turn, {I.norm_sql('text')} AS text, CASE WHEN turn % 2 = 0 THEN 'Guest ' || chr((65 + conv_id % 26)::INTEGER) END AS speaker FROM conversations""")
def _(spark, d):
    t = I.table(spark, d, "conversations")
    signed = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\r\n — "), I.guest("conv_id"), F.lit(" \n \n"))).otherwise(F.concat("text", F.lit("\n")))
    parts = t.select("conv_id", "turn", T.split_attribution(signed).alias("a"))
    return parts.select("conv_id", "turn", T.normalize_ws(F.col("a.text")).alias("text"), F.col("a.speaker").alias("speaker"))


@query("x12_quote_blocks", f"""SELECT conv_id * 1000 + turn AS doc_id, 'Guest ' || chr((65 + conv_id % 26)::INTEGER) AS speaker, trim({I.norm_sql('text')}, '"''“”‘’') AS text
FROM conversations WHERE trim({I.norm_sql('text')}, '"''“”‘’') <> ''""")
def _(spark, d):
    return extract.quote_blocks(extract.block_texts(extract.visible_items(I.quoted_pages(spark, d)))).select("doc_id", "speaker", "text")


@query("x13_list_blocks", f"""WITH {I.SEGMENTS} SELECT doc_id, string_agg({I.norm_sql('txt')}, '. ' ORDER BY seg) AS text FROM segments WHERE name = 'a' AND kind = 'open' AND {I.norm_sql('txt')} <> '' GROUP BY doc_id""")
def _(spark, d):
    items = extract.visible_items(I.pages(spark, d), silent=("style", "script"))
    return extract.list_blocks(items).select("doc_id", "text")


@query("x14_extract_blocks", f"WITH {I.PAGE_BLOCKS} SELECT doc_id, pos, type, level, speaker, text FROM page_blocks")
def _(spark, d):
    return extract.extract_blocks(I.pages(spark, d))


#: Letters of the documents, and a reference for each: by name, by an old name without its end, by number, by Windows-1252.
CODED = (("&", "&#0000038;"), ("'", "&apos;"), ('"', "&quot"), ("é", "&eacute;"), ("ü", "&#xFC;"), ("ö", "&ouml"), ("ç", "&#231"), ("ß", "&#x000df;"), ("—", "&#151;"), (".", "&period;"), (",", "&comma;"))


@query("x15_decode_entities", "SELECT doc_id, text FROM documents")
def _(spark, d):
    t, coded = I.table(spark, d, "documents"), F.col("text")
    for letter, reference in CODED:  # "&" is the first one
        if reference.endswith(";"):
            coded = F.replace(coded, F.lit(letter), F.lit(reference))
        else:  # no digit may follow a number without its end
            coded = F.regexp_replace(coded, f"{letter}(?![0-9;])", reference)
    return t.select("doc_id", T.decode_entities(coded).alias("text"))


@query("x16_documents_without_blocks", f"WITH {I.PAGE_BLOCKS} SELECT doc_id, list(type ORDER BY pos)[1] AS first_type FROM page_blocks WHERE doc_id % 7 <> 0 GROUP BY doc_id UNION ALL SELECT page_id, 'none' FROM pages WHERE page_id % 7 = 0 OR page_id NOT IN (SELECT doc_id FROM page_blocks)")
def _(spark, d):
    """Every seventh page is made one of links only."""
    links = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("<nav><p>"), F.col("url"), F.lit("</p></nav>"))).otherwise(F.col("html"))
    p = I.pages(spark, d).withColumn("html", links)
    b = extract.extract_blocks(p)
    none = extract.documents_without_blocks(p, b).select("doc_id", F.lit("none").alias("first_type"))
    return b.filter("pos = 0").select("doc_id", F.col("type").alias("first_type")).unionByName(none)


# Script


@query("n1_keep_speakable", f"WITH {I.TURNS}, {I.script_sql()} SELECT doc_id, pos, type, speaker, text FROM script_k")
def _(spark, d):
    return script.keep_speakable(I.turns(spark, d)).select("doc_id", "pos", "type", "speaker", "text")


@query("n2_apply_quote_mode", f"WITH {I.TURNS} SELECT doc_id, pos, type, speaker, text FROM turns WHERE type <> 'quote'")
def _(spark, d):
    return script.apply_quote_mode(I.turns(spark, d), "exclude").select("doc_id", "pos", "type", "speaker", "text")


@query("n3_rotate_lead_ins", f"WITH {I.TURNS}, {I.script_sql()} SELECT doc_id, block_index, text FROM script WHERE block_type = 'quote'")
def _(spark, d):
    return script.build_script(I.turns(spark, d), "two_voice").filter("block_type = 'quote'").select("doc_id", "block_index", "text")


@query("n4_build_script", f"WITH {I.TURNS}, {I.script_sql()} SELECT * FROM script")
def _(spark, d):
    return I.told(spark, d)


def _pronounced(x: str) -> str:
    # Written forms in the order of the operator; twice each, as neighbours share a separator.
    for written, spoken in sorted(RULES, key=lambda r: len(r[0]), reverse=True):
        for _ in range(2):
            x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]){written}($|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])', '\\1{spoken}\\2', 'g')"
    return x


@query("n5_apply_pronunciation", f"SELECT doc_id, {_pronounced('text')} AS text FROM documents")
def _(spark, d):
    return script.apply_pronunciation(I.table(spark, d, "documents").select("doc_id", "text"), RULES)


@query("n6_documents_without_script", f"WITH {I.TURNS}, talks AS (SELECT * EXCLUDE (type), CASE WHEN doc_id % 5 = 0 THEN 'quote' ELSE type END AS type FROM turns), {I.script_sql('exclude', 'talks')} SELECT DISTINCT doc_id FROM talks WHERE doc_id NOT IN (SELECT doc_id FROM script)")
def _(spark, d):
    """Every fifth conversation is made one of quotes only."""
    t = I.turns(spark, d).withColumn("type", F.when(F.col("doc_id") % 5 == 0, "quote").otherwise(F.col("type")))
    return script.documents_without_script(t, script.build_script(t, "exclude")).select("doc_id")


@query("n7_script_counts", f"""WITH {I.TURNS}, {I.script_sql()} SELECT t.doc_id, t.extracted, coalesce(s.kept, 0) AS kept, coalesce(s.quotes, 0) AS quotes
FROM (SELECT doc_id, count(*) AS extracted FROM turns GROUP BY 1) t LEFT JOIN (SELECT doc_id, count(*) AS kept, count(*) FILTER (WHERE block_type = 'quote') AS quotes FROM script GROUP BY 1) s USING (doc_id)""")
def _(spark, d):
    t = I.turns(spark, d)
    return script.script_counts(t, script.build_script(t))


# Chunks


@query("c1_token_count", r"SELECT doc_id, greatest(1, (length(text) + 3) // 4)::INTEGER AS chars4, len(list_filter(string_split_regex(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda w: w <> ''))::INTEGER AS words FROM documents")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("chars4"), T.token_count(F.col("text"), "words").alias("words"))


@query("c2_split_sentences", f"SELECT doc_id, unnest(range(0, len(s)))::INTEGER AS i, unnest(s) AS sentence FROM (SELECT doc_id, {I.sentences_sql('text')} AS s FROM documents)")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("i", "sentence"))


@query("c3_split_clauses", f"SELECT doc_id, unnest(range(0, len(s)))::INTEGER AS i, unnest(s) AS clause FROM (SELECT doc_id, {I.clauses_sql(I.norm_sql('text'))} AS s FROM documents)")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.posexplode(T.split_clauses(T.normalize_ws(F.col("text")))).alias("i", "clause"))


@query("c4_pack_words", f"SELECT doc_id, unnest(range(0, len(s)))::INTEGER AS i, unnest(s) AS run FROM (SELECT doc_id, {I.pack_sql('list_filter(string_split(' + I.norm_sql('text') + ', chr(32)), lambda z: len(z) > 0)', 12)} AS s FROM documents)")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.posexplode(T.pack_words(T.normalize_ws(F.col("text")), 12)).alias("i", "run"))


@query("c5_oversized_words", f"""SELECT doc_id, 0 AS block_index, CASE WHEN length(w) <= 60 THEN w ELSE left(w, 57) || '...' END AS preview, {I.tokens_sql('w')}::INTEGER AS tokens
FROM (SELECT doc_id, unnest(string_split({I.norm_sql('text')}, ' ')) AS w FROM documents) WHERE {I.tokens_sql('w')} > 4""")
def _(spark, d):
    rows = I.table(spark, d, "documents").select("doc_id", F.lit(0).alias("block_index"), "text")
    return chunk.oversized_words(rows, 4).drop("budget")


@query("c6_pack_units", f"SELECT doc_id, unnest(range(0, len(s)))::INTEGER AS i, unnest(s) AS text FROM (SELECT doc_id, {I.pack_sql(I.units_sql('text', 30), 30)} AS s FROM documents)")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.posexplode(chunk.chunk_texts(F.col("text"), 30)).alias("i", "text"))


@query("c7_build_chunks", f"WITH {I.TURNS}, {I.script_sql()}, {I.chunks_sql(8)} SELECT doc_id, block_index, part, text, paragraph_end, block_type, speaker FROM chunks")
def _(spark, d):
    return chunk.build_chunks(I.told(spark, d), 8)


@query("c8_audit_budget", f"WITH {I.CHUNKS} SELECT doc_id, block_index, {I.tokens_sql('text')}::INTEGER AS tokens, left(text, 70) AS preview FROM chunks WHERE {I.tokens_sql('text')} > 40")
def _(spark, d):
    return chunk.audit_budget(I.chunks(spark, d), 40)


@query("c9_validate_script", f"WITH {I.TURNS}, {I.script_sql()} SELECT doc_id, block_index, block_index % 5 = 0 AS rejected FROM script")
def _(spark, d):
    odd = I.told(spark, d).withColumn("block_type", F.when(F.col("block_index") % 5 == 0, "audio").otherwise(F.col("block_type")))
    ok, bad = chunk.validate_script(odd)
    return ok.select("doc_id", "block_index", F.lit(False).alias("rejected")).unionByName(bad.select("doc_id", "block_index", F.lit(True).alias("rejected")))


@query("c10_build_role_chunks", f"WITH {I.CHUNKS} SELECT doc_id, chunk_index, block_index, text, paragraph_end, block_type, speaker, role FROM chunks")
def _(spark, d):
    return I.chunks(spark, d)


@query("c10_python_counter", f"""WITH {I.TURNS}, {I.script_sql()},
chunked AS (SELECT doc_id, block_index, block_type, CASE block_type WHEN 'quote' THEN {I.pack_sql(I.units_sql('text', 9, I.words_sql), 9, I.words_sql)} ELSE {I.pack_sql(I.units_sql('text', 30), 30)} END AS c FROM script),
parts AS (SELECT doc_id, block_index, block_type, unnest(range(0, len(c)))::INTEGER AS part, unnest(c) AS text FROM (SELECT *, max(CASE WHEN len(list_filter(c, lambda x: block_type <> 'quote' AND {I.tokens_sql('x')} > 30)) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS faulty FROM chunked) WHERE faulty = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_index, part)::INTEGER AS chunk_index, block_index, CASE block_type WHEN 'quote' THEN 'quote' ELSE 'narration' END AS role, text FROM parts""")
def _(spark, d):
    @F.pandas_udf("int")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(t.split()))

    rows = chunk.build_role_chunks(I.told(spark, d), {"narration": 30, "quote": 9}, {"quote": words})
    return rows.select("doc_id", "chunk_index", "block_index", "role", "text")


@query("c11_reassemble", f"WITH {I.TURNS}, {I.script_sql()} SELECT doc_id, block_index, {I.norm_sql('text')} AS text FROM script")
def _(spark, d):
    return chunk.reassemble(chunk.build_chunks(I.told(spark, d)))


# Roles


@query("r1_with_role", f"WITH {I.TURNS}, {I.script_sql()} SELECT doc_id, block_index, CASE block_type WHEN 'quote' THEN 'quote' ELSE 'narration' END AS role, CASE block_type WHEN 'quote' THEN 250 ELSE 0 END AS extra_lead_pause_ms, CASE block_type WHEN 'quote' THEN 250 ELSE 0 END AS extra_trail_pause_ms FROM script")
def _(spark, d):
    return route.with_role(I.told(spark, d)).select("doc_id", "block_index", "role", "extra_lead_pause_ms", "extra_trail_pause_ms")


@query("r2_required_roles", f"WITH {I.ROLES} SELECT doc_id, array_to_string(roles, ',') AS roles FROM roles")
def _(spark, d):
    return I.script_roles(spark, d).select("doc_id", F.array_join("roles", ",").alias("roles"))


@query("r3_route_references", f"WITH {I.ROLES} SELECT doc_id, role, CASE role WHEN 'quote' THEN 'b.wav' ELSE 'a.wav' END AS path FROM (SELECT doc_id, unnest(roles) AS role FROM roles)")
def _(spark, d):
    return route.route_references(I.script_roles(spark, d), "two_voice", "a.wav", "b.wav")


_VALID = f"""WITH {I.ROUTED}, {I.ASSETS}, valid AS (SELECT doc_id, role, r.path, sha256, CASE WHEN r.path IS NULL THEN 'no recording is named for the voice of the ' || role
WHEN a.path IS NULL THEN 'there is no such recording for the voice of the ' || role WHEN frames <= 0 THEN 'nothing is on the recording for the voice of the ' || role END AS reason FROM routed r LEFT JOIN assets a ON a.path = r.path)"""


@query("r4_validate_references", f"{_VALID} SELECT * FROM valid")
def _(spark, d):
    return route.validate_references(I.routed(spark, d), I.assets(spark, d))


@query("r5_reject_identical_references", f"{_VALID} SELECT doc_id FROM valid GROUP BY doc_id HAVING max(path) FILTER (WHERE role = 'narration') = max(path) FILTER (WHERE role = 'quote') OR max(sha256) FILTER (WHERE role = 'narration') = max(sha256) FILTER (WHERE role = 'quote')")
def _(spark, d):
    return route.reject_identical_references(route.validate_references(I.routed(spark, d), I.assets(spark, d)), "two_voice").select("doc_id")


# Planning


@query("k1_assign_seeds", f"WITH {I.CHUNKS} SELECT doc_id, chunk_index, CASE WHEN length(text) % 10 = 0 THEN length(text) ELSE 1234 + chunk_index END::BIGINT AS seed FROM chunks")
def _(spark, d):
    c = I.chunks(spark, d)
    overrides = c.filter(F.char_length("text") % 10 == 0).select(F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("bigint").alias("seed")).distinct()
    return cache.assign_seeds(c, overrides).select("doc_id", "chunk_index", "seed")


@query("k2_canonical_json", """SELECT conv_id, turn, to_json({'a': {'half': turn / 2::DOUBLE, 'n': NULL, 'turn': turn}, 'list': [{'k': 1, 'z': role}], 'role': role, 'text': text})::VARCHAR AS json FROM conversations""")
def _(spark, d):
    inner = F.struct("turn", F.lit(None).cast("string").alias("n"), (F.col("turn") / 2).alias("half")).alias("a")
    rows = I.table(spark, d, "conversations").withColumn("v", F.struct("text", F.array(F.struct(F.col("role").alias("z"), F.lit(1).alias("k"))).alias("list"), "role", inner))
    return rows.select("conv_id", "turn", T.canonical_json(F.col("v"), rows.schema["v"].dataType).alias("json"))


@query("k4_generation_payload", f"WITH {I.KEYED} SELECT doc_id, chunk_index, payload_json FROM keyed")
def _(spark, d):
    return I.keyed(spark, d).select("doc_id", "chunk_index", "payload_json")


@query("k3_payload_key", f"WITH {I.KEYED} SELECT doc_id, chunk_index, cache_key, file_stem FROM keyed")
def _(spark, d):
    return I.keyed(spark, d).select("doc_id", "chunk_index", "cache_key", "file_stem")


_VOICES = f"""WITH {I.MODELS}, {I.ASSETS}, pick AS (SELECT CASE WHEN path = 'voice_1' THEN 'narration' ELSE 'quote' END AS role, path, sha256, sha256(path) AS anchor_sha256 FROM assets WHERE path <> ''),
v AS (SELECT role, path, sha256(to_json({{'anchor_seconds': 15, 'cut_algorithm': 'low_energy_20ms_v1', 'source_sha256': sha256}})::VARCHAR) AS anchor_key,
to_json({{'anchor_cut_algorithm': 'low_energy_20ms_v1', 'anchor_seconds_requested': 15, 'anchor_sha256': anchor_sha256, 'model': {I.MODEL_SQL}, 'quantize': false, 'schema': 2}})::VARCHAR AS voice_json FROM pick JOIN models USING (role)),
w AS (SELECT role, anchor_key, sha256(voice_json) AS voice_key, voice_json FROM v)"""


def _identities(spark, d):
    a = I.assets(spark, d).select(F.when(F.col("path") == "voice_1", "narration").otherwise("quote").alias("role"), "sha256", F.sha2("path", 256).alias("anchor_sha256"))
    return cache.voice_identity(a, I.models(spark, d))


@query("k5_voice_identity", f"{_VOICES} SELECT role, anchor_key, voice_key FROM w")
def _(spark, d):
    return _identities(spark, d).select("role", "anchor_key", "voice_key")


@query("k6_classify_cache", f"WITH {I.MANIFESTS} SELECT doc_id, chunk_index, status FROM classified")
def _(spark, d):
    return cache.classify_cache(I.keyed(spark, d), I.manifests(spark, d), 24000).select("doc_id", "chunk_index", "status")


@query("k6_lookup", f"WITH {I.MANIFESTS} SELECT doc_id, chunk_index, status FROM classified")
def _(spark, d):
    """The same, from a manifest table that only gives what the chunks may want."""
    table = ManifestTable(spark, shared_path(spark, "manifests"), 16, key="file_stem")
    table.upsert(I.manifests(spark, d).withColumn("created_utc", F.lit(0)))
    keyed = written(I.keyed(spark, d), "keyed")
    return cache.classify_cache(keyed, table.lookup(keyed).drop("created_utc"), 24000).select("doc_id", "chunk_index", "status")


@query("k6_sound_files", f"""SELECT vec_id, CASE vec_id % 11 WHEN 0 THEN 'miss' WHEN 1 THEN 'the manifest is of another payload' WHEN 2 THEN 'the manifest names no hash' WHEN 3 THEN 'the sound has another rate'
WHEN 4 THEN 'the sound is empty' WHEN 5 THEN 'the sound has NaN or infinite samples' WHEN 6 THEN 'the file''s hash is not the manifest''s' WHEN 7 THEN 'the file''s length is not the manifest''s' ELSE 'hit' END AS status FROM embeddings WHERE embedding IS NOT NULL""")
def _(spark, d):
    """A cache of real files, some of them made wrong, some with manifests that are: every signal is a chunk."""
    m = F.col("doc_id") % 11
    s = I.signals(spark, d).select(F.col("id").alias("doc_id"), F.lit(0).alias("from_sample"), "samples")
    odd = F.when(m == 4, F.array().cast("array<float>")).when(m == 5, F.concat(F.array(F.lit(float("nan")).cast("float")), F.col("samples"))).otherwise(F.col("samples"))
    folder = shared_path(spark, "cache")
    made = wav.write_sounds(s.filter(m != 0).withColumn("samples", odd), s.select("doc_id", I.sound_name("doc_id").alias("name"), F.when(m == 3, 8000).otherwise(I.SR).alias("sr")), I.SR, folder)
    payload = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit("}"))
    stem = F.regexp_replace(I.sound_name("doc_id"), ".wav$", "").alias("file_stem")
    manifests = made.select(stem, F.when(m == 1, "{}").otherwise(payload).alias("payload_json"), F.when(m == 2, "").when(m == 6, "x").otherwise(F.col("sha256")).alias("wav_sha256"), F.when(m == 7, 1).otherwise(F.col("frames")).alias("frames"))
    chunks = s.select(F.col("doc_id").alias("vec_id"), stem, payload.alias("payload_json"))
    return cache.classify_cache(chunks, cache.with_sounds(manifests, wav.read_sounds(spark, folder)), I.SR).select("vec_id", "status")


@query("k7_classify_voice_cache", f"{_VOICES} SELECT voice_key, CASE WHEN substr(voice_key, 1, 1) < '8' THEN 'hit' ELSE 'rebuild' END AS status FROM w")
def _(spark, d):
    v = _identities(spark, d)
    kept = v.select(F.substring("voice_key", 1, 16).alias("file_stem"), F.col("voice_json").alias("payload_json"), F.col("anchor_key").alias("state_sha256"), F.when(F.substring("voice_key", 1, 1) < "8", F.col("anchor_key")).otherwise("x").alias("actual_sha256"))
    return cache.classify_voice_cache(v, kept).select("voice_key", "status")


@query("k8_pending_work", f"WITH {I.MANIFESTS} SELECT cache_key, min(doc_id * 1000000 + chunk_index) // 1000000 AS doc_id, (min(doc_id * 1000000 + chunk_index) % 1000000)::INTEGER AS chunk_index, count(*) AS wanted_by FROM classified WHERE status <> 'hit' GROUP BY cache_key")
def _(spark, d):
    return cache.pending_work(cache.classify_cache(I.keyed(spark, d), I.manifests(spark, d), 24000))


_LAST = "SELECT user_id AS cache_key, event_id AS frames FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, (event_type = 'click') DESC, event_id DESC) AS r FROM events) WHERE r = 1"


def _events(spark, d):
    """Users' events as manifests, old ones and (clicks) new ones."""
    e = I.table(spark, d, "events").groupBy("user_id", "ts", (F.col("event_type") == "click").alias("new")).agg(F.max("event_id").alias("frames"))
    e = e.select(F.col("user_id").alias("cache_key"), F.col("ts").alias("created_utc"), "frames", "new")
    return e.filter("NOT new").drop("new"), e.filter("new").drop("new")


@query("k9_upsert_manifests", _LAST)
def _(spark, d):
    return cache.upsert_manifests(*_events(spark, d)).select("cache_key", "frames")


@query("k9_manifest_table", _LAST)
def _(spark, d):
    """Two changes of a table in place."""
    table = ManifestTable(spark, shared_path(spark, "manifests"), 16)
    for rows in _events(spark, d):
        table.upsert(rows)
    return table.read().select("cache_key", "frames")


# Signals

_WIDTH = signal.samples_in(I.SR, signal.WINDOW_MS)
_RMS = f"{I.SIGNALS}, win AS (SELECT id, n, i // {_WIDTH} AS w, count(*) AS size, sqrt(avg(x * x)) AS rms FROM samples GROUP BY ALL)"
_ACT = f"{_RMS}, act AS (SELECT id, n, min(w * {_WIDTH})::INTEGER AS start, max(w * {_WIDTH} + size)::INTEGER AS \"end\" FROM win WHERE rms > {I.LOUD} GROUP BY id, n)"
_K0, _K1 = signal.samples_in(I.SR, 12), signal.samples_in(I.SR, 8)
_TRIM = f"{_ACT}, crop AS (SELECT id, start, \"end\", greatest(0, start - {_K0}) AS lo, least(n, \"end\" + {_K1}) AS hi FROM act), trimmed AS (SELECT s.id, hi - lo AS n, i - lo AS i, x, start - lo AS start, \"end\" - lo AS \"end\" FROM samples s JOIN crop c USING (id) WHERE i >= lo AND i < hi)"


def _faded(source: str, fade: int) -> str:
    m = f"least({fade}, n // 4)"
    return f"""SELECT id, i, round(x * CASE WHEN i < {m} THEN CASE WHEN {m} = 1 THEN 0.0 ELSE i / greatest({m} - 1, 1)::DOUBLE END ELSE 1.0 END
* CASE WHEN i >= n - {m} THEN CASE WHEN {m} = 1 THEN 1.0 ELSE (n - 1 - i) / greatest({m} - 1, 1)::DOUBLE END ELSE 1.0 END, 6) + 0.0 AS x FROM {source}"""


@query("a1_explode_samples", f"WITH {I.SIGNALS} SELECT id, n, i, x FROM samples")
def _(spark, d):
    return I.samples(spark, d)


@query("a2_downmix", f"WITH {I.SIGNALS} SELECT id, (i // 2)::INTEGER AS i, round(avg(x), 6) + 0.0 AS x FROM samples GROUP BY ALL")
def _(spark, d):
    two = I.samples(spark, d).withColumn("i", F.floor(F.col("i") / 2).cast("int"))
    return signal.downmix(two).withColumn("x", R6(F.col("x")))


@query("a3_validate_signals", "SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'the rate is 8000, not 250' WHEN vec_id % 5 = 0 THEN 'there is more than one channel' WHEN vec_id % 3 = 0 THEN 'there are no samples' WHEN vec_id % 2 = 0 THEN 'a sample is NaN or infinite' END AS reason FROM embeddings")
def _(spark, d):
    i = F.col("id")
    nan = F.transform("samples", lambda x, k: F.when(k == 5, F.lit(float("nan"))).otherwise(x).cast("float"))
    s = I.signals(spark, d).select("id", F.when(i % 7 == 0, 8000).otherwise(I.SR).alias("sr"), F.when(i % 5 == 0, 2).otherwise(1).alias("channels"), F.when(i % 3 == 0, F.array().cast("array<float>")).when(i % 2 == 0, nan).otherwise(F.col("samples")).alias("samples"))
    return signal.validate_signals(s, I.SR).select("id", "reason")


@query("a4_rms_windows", f"WITH {_RMS} SELECT id, w::BIGINT AS w, size, round(rms, 6) AS rms FROM win")
def _(spark, d):
    return packed.rms_windows(I.signals(spark, d), I.SR).select("id", "w", "size", R6(F.col("rms")).alias("rms"))


@query("a5_detect_activity", f"WITH {_ACT} SELECT id, n, start, \"end\" FROM act")
def _(spark, d):
    return packed.detect_activity(I.signals(spark, d), I.SR, I.LOUD)


@query("a6_trim_silence", f"WITH {_TRIM} SELECT id, n, i, x, start, \"end\" FROM trimmed")
def _(spark, d):
    t = packed.trim_silence(I.signals(spark, d), I.SR, 12, 8, I.LOUD).withColumn("n", F.size("samples"))
    return packed.explode_samples(t, "id", "n", "start", "end").withColumn("x", F.col("x").cast("double"))


@query("a7_edge_fade", f"WITH {I.SIGNALS} {_faded('samples', signal.samples_in(I.SR, 20))}")
def _(spark, d):
    return packed.explode_samples(packed.edge_fade(I.signals(spark, d), I.SR, 20), "id").withColumn("x", R6(F.col("x")))


@query("a8_normalize_peak", f"WITH {I.SIGNALS}, peak AS (SELECT label, max(abs(x)) AS p FROM samples GROUP BY label) SELECT id, i, label, round(x * (0.95::DOUBLE / p), 6) + 0.0 AS x FROM samples JOIN peak USING (label) WHERE p > 0")
def _(spark, d):
    return packed.explode_samples(packed.normalize_peak(I.signals(spark, d), "label"), "id", "label").withColumn("x", R6(F.col("x")))


@query("a8_documents_without_peak", "SELECT label, CASE label % 3 WHEN 0 THEN 'all samples are zero' ELSE 'a sample is NaN or infinite' END AS reason FROM (SELECT DISTINCT label FROM embeddings WHERE embedding IS NOT NULL) WHERE label % 3 < 2")
def _(spark, d):
    """Labels as documents; a third of them are made silent, a third get a NaN."""
    kind = F.col("label") % 3
    long = signal.explode_samples(I.signals(spark, d), ("id", "label")).withColumn("x", F.when(kind == 0, 0.0).when((kind == 1) & (F.col("i") == 7), float("nan")).otherwise(F.col("x")))
    return signal.documents_without_peak(long, "label")


_CUT_W, _CUT_H = max(1, int(0.02 * I.SR)), max(1, max(1, int(0.02 * I.SR)) // 4)
_CUT_T, _CUT_R = int(0.12 * I.SR), int(0.08 * I.SR)
_CUT_L = max(_CUT_W, _CUT_T - _CUT_R)
_CUT = f"""{I.SIGNALS}, grid AS (SELECT id, n, unnest(range({_CUT_L}, least(n - {_CUT_W}, {_CUT_T + _CUT_R}), {_CUT_H})) AS spot FROM (SELECT DISTINCT id, n FROM samples)),
energy AS (SELECT g.id, spot, sqrt(avg(x * x)) AS rms FROM grid g JOIN samples s ON s.id = g.id AND s.i >= spot AND s.i < spot + {_CUT_W} GROUP BY g.id, spot),
best AS (SELECT id, arg_min(spot, (rms, spot)) AS spot FROM energy GROUP BY id),
cuts AS (SELECT l.id, n, CASE WHEN least(n - {_CUT_W}, {_CUT_T + _CUT_R}) <= {_CUT_L} THEN least({_CUT_T}, n) ELSE spot END::INTEGER AS cut FROM (SELECT DISTINCT id, n FROM samples) l LEFT JOIN best USING (id))"""


@query("a9_quiet_cutpoint", f"WITH {_CUT} SELECT id, n, cut FROM cuts")
def _(spark, d):
    return packed.quiet_cutpoint(I.signals(spark, d), I.SR, 0.12, 0.08)


_PCM = "string_agg(least(greatest(round(x * 32768)::INTEGER, -32768), 32767)::VARCHAR, ',' ORDER BY i)"


@query("a10_voice_anchor", f"""WITH {_CUT} SELECT s.id, sha256({_PCM}) AS source_sha256, sha256({_PCM} FILTER (WHERE i < cut)) AS anchor_sha256, {I.SR} AS sample_rate, count(*) FILTER (WHERE i < cut) AS frames,
count(*) FILTER (WHERE i < cut) / {I.SR}::DOUBLE AS duration_seconds, max(abs(x)) FILTER (WHERE i < cut) AS peak FROM samples s JOIN cuts USING (id) GROUP BY s.id HAVING count(*) FILTER (WHERE i < cut) > 0""")
def _(spark, d):
    return packed.voice_anchor(I.signals(spark, d), I.SR, 0.12, 0.08)


@query("a11_render_chunks", f"WITH {_ACT.replace(f'rms > {I.LOUD}', f'rms > {signal.THRESHOLD}')}, crop AS (SELECT id, greatest(0, start - 25) AS lo, least(n, \"end\" + 20) AS hi FROM act), trimmed AS (SELECT s.id, hi - lo AS n, i - lo AS i, x FROM samples s JOIN crop c USING (id) WHERE i >= lo AND i < hi) {_faded('trimmed', 1)}")
def _(spark, d):
    return packed.explode_samples(packed.render_chunks(I.signals(spark, d), I.SR), "id").withColumn("x", R6(F.col("x")))


# Timeline

_ENDS = r"regexp_matches(text, '[.!?]\s*$')"
_PAUSE = f"CASE WHEN paragraph_end THEN 700 WHEN {_ENDS} THEN 350 ELSE 150 END"
_GAPS = I.SOUNDING + f""", gap_a AS (SELECT *, CASE block_type WHEN 'quote' THEN 250 ELSE 0 END AS extra, {_PAUSE} AS pause_ms FROM sounding),
gap_b AS (SELECT *, lead(extra) OVER w AS next_extra, lead(start) OVER w AS next_start FROM gap_a WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
gaps AS (SELECT *, pause_ms + extra + next_extra AS target_ms, CASE WHEN next_extra IS NOT NULL THEN greatest(round_even({I.SR} * (pause_ms + extra + next_extra) / 1000.0, 0)::INTEGER - (n - "end" + next_start), 0) END AS inserted FROM gap_b),
placed AS (SELECT *, greatest(round_even({I.SR} * 700 / 1000.0, 0)::INTEGER - first_value(start) OVER w, 0) AS lead, (greatest(round_even({I.SR} * 700 / 1000.0, 0)::INTEGER - first_value(start) OVER w, 0)
  + coalesce(sum(n + coalesce(inserted, 0)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS from_sample FROM gaps WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))"""


@query("t1_boundary_kind", f"WITH {I.CHUNKS} SELECT doc_id, chunk_index, CASE WHEN paragraph_end THEN 'paragraph' WHEN {_ENDS} THEN 'sentence' ELSE 'clause' END AS boundary FROM chunks")
def _(spark, d):
    return timeline.boundary_kind(I.chunks(spark, d)).select("doc_id", "chunk_index", "boundary")


@query("t2_pause_ms", f"WITH {I.CHUNKS} SELECT doc_id, chunk_index, {_PAUSE} AS pause_ms FROM chunks")
def _(spark, d):
    return timeline.pause_ms(I.chunks(spark, d)).select("doc_id", "chunk_index", "pause_ms")


@query("t3_gap_plan", f"WITH {_GAPS} SELECT doc_id, chunk_index, target_ms, inserted FROM gaps")
def _(spark, d):
    return timeline.gap_plan(I.sounding(spark, d), I.SR).select("doc_id", "chunk_index", "target_ms", "inserted")


@query("t4_lead_in", f"WITH {_GAPS} SELECT doc_id, lead FROM placed WHERE chunk_index = 1")
def _(spark, d):
    return timeline.lead_in(I.sounding(spark, d), I.SR)


@query("t5_layout", f"WITH {_GAPS} SELECT doc_id, chunk_index, from_sample, from_sample + n AS to_sample, round(from_sample / {I.SR}::DOUBLE, 6) AS from_s, round((from_sample + n) / {I.SR}::DOUBLE, 6) AS to_s FROM placed")
def _(spark, d):
    return timeline.layout(I.sounding(spark, d), I.SR).select("doc_id", "chunk_index", "from_sample", "to_sample", R6(F.col("from_s")).alias("from_s"), R6(F.col("to_s")).alias("to_s"))


#: Of so many vectors in a row one document is made.
_TURNS = 40
_JOINED = I.SIGNALS + f""", turns AS (SELECT vec_id // {_TURNS} AS doc_id, vec_id, embedding, row_number() OVER w AS chunk_index, lead(vec_id) OVER w AS nxt FROM embeddings WHERE embedding IS NOT NULL WINDOW w AS (PARTITION BY vec_id // {_TURNS} ORDER BY vec_id)),
spans AS (SELECT doc_id, chunk_index, vec_id, len(embedding) AS n, CASE WHEN nxt IS NOT NULL THEN vec_id % 4 END AS gap FROM turns),
laid AS (SELECT *, 5 + coalesce(sum(n + coalesce(gap, 0)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_sample FROM spans),
joined AS (SELECT doc_id, from_sample + i AS i, x FROM laid JOIN samples ON id = vec_id UNION ALL SELECT doc_id, unnest(range(0, 5)), 0.0 FROM laid WHERE chunk_index = 1 UNION ALL SELECT doc_id, unnest(range((from_sample + n)::BIGINT, (from_sample + n + coalesce(gap, 0))::BIGINT)), 0.0 FROM laid)"""


@query("t6_join_signals", f"WITH {_JOINED} SELECT doc_id::BIGINT AS doc_id, i::BIGINT AS i, x FROM joined")
def _(spark, d):
    s = I.signals(spark, d).withColumn("doc_id", F.floor(F.col("id") / _TURNS))
    w = Window.partitionBy("doc_id").orderBy("id")
    rows = s.select("doc_id", "id", F.size("samples").alias("n"), F.row_number().over(w).alias("chunk_index"))
    rows = rows.withColumn("inserted", F.when(F.lead("id").over(w).isNotNull(), (F.col("id") % 4).cast("int"))).withColumn("lead", F.lit(5))
    rows = rows.withColumn("from_sample", F.lit(5) + F.coalesce(F.sum(F.col("n") + F.coalesce("inserted", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("to_sample", F.col("from_sample") + F.col("n"))
    pieces = packed.join_signals(s.join(placed.select("id", "chunk_index").hint("shuffle_merge"), "id"), placed)
    return packed.explode_samples(pieces, "doc_id", "from_sample").select("doc_id", (F.col("from_sample") + F.col("i")).alias("i"), "x")


@query("t7_run_summary", f"WITH {_GAPS} SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE role = 'narration') AS narration, count(*) FILTER (WHERE role = 'quote') AS quotes, round(max(from_sample + n) / {I.SR}::DOUBLE, 6) AS duration_s, round(max(from_sample + n) / {I.SR}::DOUBLE / 60, 6) AS duration_min FROM placed GROUP BY doc_id")
def _(spark, d):
    s = timeline.run_summary(timeline.layout(I.sounding(spark, d), I.SR), I.SR)
    return s.withColumns({"duration_s": R6(F.col("duration_s")), "duration_min": R6(F.col("duration_min"))})


# Intake


@query("q1_split_requests", f"SELECT conv_id, turn, {I.blank_sql('text')} OR turn % 9 = 8 AS rejected FROM conversations")
def _(spark, d):
    r = I.table(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 9 == 8, " \t").otherwise(F.col("text")))
    ok, bad = intake.split_requests(r)
    return ok.select("conv_id", "turn", F.lit(False).alias("rejected")).unionByName(bad.select("conv_id", "turn", F.lit(True).alias("rejected")))


_PAGES_KEYED = I.KEYED.replace(I.CHUNKS, f"{I.PAGE_BLOCKS}, {I.script_sql(source='page_blocks')}, {I.chunks_sql()}")


@query("q2_resume_stream", f"WITH {_PAGES_KEYED} SELECT DISTINCT ON (cache_key) cache_key, doc_id, chunk_index, role, text, seed, payload_json FROM keyed ORDER BY cache_key, doc_id, chunk_index")
def _(spark, d):
    """The posts arrive as a stream; returns the work that the run asks for."""
    p = I.pages(spark, d)
    stream = spark.readStream.schema(p.schema).parquet(d + "/pages.parquet*")
    out, done = shared_path(spark, "todo"), shared_path(spark, "done")
    intake.resume_stream(spark, stream, I.models(spark, d), I.voices(spark, d), done, out, shared_path(spark, "offsets"), shared_path(spark, "bad")).awaitTermination()
    return spark.read.parquet(out)


# The flagship: posts to routed, paused chunks


def plan(pages: DataFrame, budget: int = chunk.BUDGET) -> tuple[DataFrame, DataFrame]:
    """The plan, and what is left out of it.

    The plan: doc_id, chunk_index, block_index, block_type, role, tokens, boundary,
    pause_ms, text. Left out, whole: posts without text or blocks, and posts with a word
    over the budget; doc_id, block_index, reason, preview, tokens.
    """
    blocks = written(extract.extract_blocks(pages), "blocks")  # several passes over them, but one over the pages
    told = script.build_script(blocks)
    return routed_chunks(told, budget), chunk.quarantine(told, budget).unionByName(extract.rejected_pages(pages, blocks), allowMissingColumns=True)


def routed_chunks(told: DataFrame, budget: int = chunk.BUDGET) -> DataFrame:
    timed = timeline.pause_ms(timeline.boundary_kind(chunk.build_role_chunks(told, budget)))
    return timed.select("doc_id", "chunk_index", "block_index", "block_type", "role", T.token_count(F.col("text")).alias("tokens"), "boundary", "pause_ms", "text")


@query("flagship_plan", f"WITH {I.PAGE_BLOCKS}, {I.script_sql(source='page_blocks')}, {I.chunks_sql()} SELECT doc_id, chunk_index, block_index, block_type, role, {I.tokens_sql('text')}::INTEGER AS tokens, CASE WHEN paragraph_end THEN 'paragraph' WHEN {_ENDS} THEN 'sentence' ELSE 'clause' END AS boundary, {_PAUSE} AS pause_ms, text FROM chunks")
def _(spark, d):
    return routed_chunks(script.build_script(extract.extract_blocks(I.pages(spark, d))))


def _quarantine_sql(budget: int) -> str:
    """With every ninth page blank and every seventh one without a block."""
    words = f"SELECT doc_id, block_index, unnest(string_split({I.norm_sql('text')}, ' ')) AS w FROM script WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0"
    return f"""WITH {I.PAGE_BLOCKS}, {I.script_sql(source='page_blocks')}, words AS ({words})
SELECT doc_id, block_index, 'a word is over the budget' AS reason, CASE WHEN length(w) <= 60 THEN w ELSE left(w, 57) || '...' END AS preview, {I.tokens_sql('w')}::INTEGER AS tokens FROM words WHERE {I.tokens_sql('w')} > {budget}
UNION ALL SELECT page_id, NULL::INTEGER, CASE WHEN page_id % 9 = 0 THEN 'the page is empty' ELSE 'the page has no block to narrate' END, NULL::VARCHAR, NULL::INTEGER FROM pages WHERE page_id % 9 = 0 OR page_id % 7 = 0"""


@query("flagship_quarantine", _quarantine_sql(4))
def _(spark, d):
    html = F.when(F.col("page_id") % 9 == 0, " \n").when(F.col("page_id") % 7 == 0, F.concat(F.lit("<nav>"), F.col("url"), F.lit("</nav>"))).otherwise(F.col("html"))
    return plan(I.pages(spark, d).withColumn("html", html), 4)[1]
