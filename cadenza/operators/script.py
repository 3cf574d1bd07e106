"""Blocks to a narration script: filters, quote policy, rotating lead-ins, pronunciation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from cadenza.functions import text as T
from cadenza.functions.rules import apply_rules

#: Fixed values of the script's rules.
VERBS = ("says", "shares", "reflects", "feels")
MODES = ("preserve", "exclude", "two_voice")
TYPES = ("paragraph", "heading", "list", "quote")
MOST_RULES = 1 << 20


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


def keep_speakable(blocks: DataFrame) -> DataFrame:
    """The four known types with text that isn't blank; only quotes keep their speaker."""
    known = F.col("type").isin(*TYPES) & ~T.is_blank(F.col("text"))
    return blocks.filter(known).withColumn("speaker", F.when(F.col("type") == "quote", F.col("speaker")))


def apply_quote_mode(blocks: DataFrame, mode: str = "preserve") -> DataFrame:
    """``exclude`` drops quotes; ``preserve`` and ``two_voice`` keep them, with the same text."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    return blocks.filter(~F.col("type").eqNullSafe("quote")) if mode == "exclude" else blocks


def rotate_lead_ins(blocks: DataFrame, verbs: Sequence[str] = VERBS) -> DataFrame:
    """The n-th attributed quote of a document is led in by its speaker and the n-th verb, in rotation."""
    led = (F.col("type") == "quote") & (F.coalesce("speaker", F.lit("")) != "")
    nth = F.sum(F.when(led, 1).otherwise(0)).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    verb = F.element_at(F.array(*map(F.lit, verbs)), ((F.col("_nth") - 1) % len(verbs) + 1).cast("int"))
    spoken = F.concat("speaker", F.lit(" "), verb, F.lit(', "'), "text", F.lit('"'))
    return blocks.withColumn("_nth", nth).withColumn("text", F.when(led, spoken).otherwise(F.col("text"))).drop("_nth")


def build_script(blocks: DataFrame, mode: str = "preserve") -> DataFrame:
    """doc_id, block_index (from 0), block_type, text, speaker.

    Quotes that the mode drops go before the window, which no filter can pass.
    """
    kept = rotate_lead_ins(keep_speakable(apply_quote_mode(blocks, mode)))
    return kept.select("doc_id", (F.row_number().over(in_order()) - 1).alias("block_index"), F.col("type").alias("block_type"), "text", "speaker")


def rule_table(rules: DataFrame | Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules in their order of use: longest written form first, otherwise as given (a table's by its forms); at most MOST_RULES, as every task gets them all."""
    if isinstance(rules, DataFrame):
        rules = [tuple(r) for r in rules.select("written", "spoken").orderBy("written", "spoken").limit(MOST_RULES + 1).collect()]
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    if any(not written or not spoken for written, spoken in rules):
        raise ValueError("a rule needs a written and a spoken form")
    return sorted(rules, key=lambda r: len(r[0]), reverse=True)


def apply_pronunciation(script: DataFrame, rules: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Written forms to spoken ones: whole words, longest written form first, one after the other; replacements are literal.

    ``rules``: pairs, or a table of written and spoken.
    """
    return script.withColumn("text", apply_rules(F.col("text"), rule_table(rules)))


def documents_without_script(blocks: DataFrame, script: DataFrame) -> DataFrame:
    """doc_id, reason of documents of which the quote policy left nothing."""
    ids = blocks.select("doc_id").distinct()
    return ids.join(script.select("doc_id").distinct().hint("shuffle_merge"), "doc_id", "left_anti").withColumn("reason", F.lit("the quote mode leaves nothing to narrate"))


def script_counts(blocks: DataFrame, script: DataFrame) -> DataFrame:
    """doc_id, extracted, kept, quotes."""
    before = blocks.groupBy("doc_id").agg(F.count("*").alias("extracted"))
    after = script.groupBy("doc_id").agg(F.count("*").alias("kept"), F.count_if(F.col("block_type") == "quote").alias("quotes"))
    return before.join(after.hint("shuffle_merge"), "doc_id", "left").fillna(0, ["kept", "quotes"])
