"""Pauses, gaps and the place of every chunk in the joined recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from cadenza.operators.route import with_role

#: Fixed values in ms.
PARAGRAPH_MS, SENTENCE_MS, CLAUSE_MS, LEAD_MS = 700, 350, 150, 700


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("chunk_index")


def _ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?]\s*\z")


def boundary_kind(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("boundary", F.when(F.col("paragraph_end"), "paragraph").when(_ends_sentence(F.col("text")), "sentence").otherwise("clause"))


def pause_ms(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("pause_ms", F.when(F.col("paragraph_end"), PARAGRAPH_MS).when(_ends_sentence(F.col("text")), SENTENCE_MS).otherwise(CLAUSE_MS))


def _samples(sr: int, ms: Column) -> Column:
    return F.bround(F.lit(sr) * ms / 1000.0).cast("int")


def gap_plan(chunks: DataFrame, sr: int) -> DataFrame:
    """``chunks`` (with n, start, end of their signal) and target_ms, inserted: zeros behind every chunk but the last (null there)."""
    rows = with_role(pause_ms(chunks))
    following = F.lead(F.struct("extra_lead_pause_ms", "start")).over(in_order())
    rows = rows.withColumn("_next", following)
    target = F.col("pause_ms") + F.col("extra_trail_pause_ms") + F.col("_next.extra_lead_pause_ms")
    natural = F.col("n") - F.col("end") + F.col("_next.start")
    return rows.withColumn("target_ms", target).withColumn("inserted", F.when(F.col("_next").isNotNull(), F.greatest(_samples(sr, target) - natural, F.lit(0))).cast("int")).drop("_next")


def lead_in(chunks: DataFrame, sr: int) -> DataFrame:
    """doc_id, lead: zeros before a document's first chunk."""
    first = chunks.groupBy("doc_id").agg(F.min(F.struct("chunk_index", "start")).alias("f"))
    return first.select("doc_id", F.greatest(_samples(sr, F.lit(LEAD_MS)) - F.col("f.start"), F.lit(0)).cast("int").alias("lead"))


def layout(chunks: DataFrame, sr: int) -> DataFrame:
    """gap_plan's rows with lead, from_sample, to_sample, from_s, to_s in the joined recording."""
    rows = gap_plan(chunks, sr)
    first = F.first("start").over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    lead = F.greatest(_samples(sr, F.lit(LEAD_MS)) - first, F.lit(0))
    before = F.coalesce(F.sum(F.col("n") + F.coalesce("inserted", F.lit(0))).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("lead", lead.cast("int")).withColumn("from_sample", (lead + before).cast("long"))
    rows = rows.withColumn("to_sample", F.col("from_sample") + F.col("n"))
    return rows.withColumn("from_s", F.col("from_sample") / sr).withColumn("to_s", F.col("to_sample") / sr)


def join_signals(samples: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, i, x: one series for each document, silence as zeros.

    ``samples``: doc_id, chunk_index, i, x; ``placed``: rows of layout().
    """
    spans = placed.select("doc_id", "chunk_index", "from_sample", "to_sample", "inserted", "lead")
    heard = samples.select("doc_id", "chunk_index", "i", "x").join(spans.hint("shuffle_merge"), ["doc_id", "chunk_index"]).select("doc_id", (F.col("from_sample") + F.col("i")).alias("i"), "x")
    zeros = lambda n, start: F.transform(F.sequence(F.lit(1), n), lambda k: start + k - 1)
    none = F.array().cast("array<bigint>")
    behind = F.when(F.coalesce("inserted", F.lit(0)) > 0, zeros(F.col("inserted"), F.col("to_sample"))).otherwise(none)
    ahead = F.when((F.col("chunk_index") == 1) & (F.col("lead") > 0), zeros(F.col("lead"), F.lit(0).cast("long"))).otherwise(none)
    quiet = spans.select("doc_id", F.explode(F.concat(ahead, behind)).alias("i"), F.lit(0.0).alias("x"))
    return heard.unionByName(quiet)


def run_summary(placed: DataFrame, sr: int) -> DataFrame:
    """doc_id, chunks, narration, quotes, duration_s, duration_min."""
    out = placed.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("role") == "narration").alias("narration"), F.count_if(F.col("role") == "quote").alias("quotes"), F.max("to_sample").alias("_end"))
    return out.withColumn("duration_s", F.col("_end") / sr).withColumn("duration_min", F.col("_end") / sr / 60).drop("_end")
