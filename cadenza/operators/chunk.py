"""Script to chunks under a token budget."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.functions import counted, text as T
from cadenza.functions.text import Counter
from cadenza.operators.script import TYPES

BUDGET = 44


def valid_budget(budget: int) -> int:
    if isinstance(budget, bool) or not isinstance(budget, int) or budget <= 0:
        raise ValueError("budget must be a positive integer")
    return budget


def validate_script(script: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Rows that can be chunked, and rows of unknown type with a reason; blank text is neither, its index stays used."""
    valid_budget(budget)
    if dict(script.dtypes)["text"] not in ("string", "void"):
        raise TypeError("text must be a string")
    known = F.coalesce(F.col("block_type").isin(*TYPES), F.lit(False))
    reason = F.concat(F.lit("block "), F.col("block_index").cast("string"), F.lit(" is of no known type"))
    return script.filter(known & ~T.is_blank(F.col("text"))), script.filter(~known).withColumn("reason", reason)


def oversized_words(script: DataFrame, budget: int = BUDGET, counter: str | Counter = "chars4") -> DataFrame:
    """doc_id, block_index, preview, tokens, budget: words that alone are over the budget."""
    valid_budget(budget)
    rows = script.filter(~T.is_blank(F.col("text"))).select("doc_id", "block_index", F.explode(F.split(T.normalize_ws(F.col("text")), " ")).alias("word"))
    preview = F.when(F.char_length("word") <= 60, F.col("word")).otherwise(F.concat(F.substring("word", 1, 57), F.lit("...")))
    return rows.withColumn("tokens", T.token_count(F.col("word"), counter)).filter(F.col("tokens") > budget).select("doc_id", "block_index", preview.alias("preview"), "tokens", F.lit(budget).alias("budget"))


def _packed(text: Column, budget: int, counter: str | Counter) -> Column:
    """struct<chunks, over>: a block's chunks, and whether one is over the budget.

    Named and Python counters are packed in Arrow batches; other functions from column to column in the JVM.
    """
    if not callable(counter):
        T.token_count(text, counter)
    if not callable(counter) or counted.is_python(counter):
        return counted.chunks(text, budget, counter)
    return T.let(T.pack(T.split_units(text, budget, counter), budget, counter), lambda c: F.struct(c.alias("chunks"), F.exists(c, lambda x: T.token_count(x, counter) > budget).alias("over")))


def chunk_texts(text: Column, budget: int, counter: str | Counter = "chars4") -> Column:
    """Chunks of one block's text."""
    return _packed(text, valid_budget(budget), counter)["chunks"]


def _rows(script: DataFrame, packed: Column, strict: bool) -> DataFrame:
    """A row for each of a block's chunks; ``packed`` is struct<chunks, over>.

    A document with a faulty block is left out whole: the fault is spread over the
    document by a window, in the partitioning that the script's own windows have.
    """
    known = F.coalesce(F.col("block_type").isin(*TYPES), F.lit(False))
    over = F.coalesce(F.col("_packed.over"), F.lit(False))
    if strict:
        kind = F.when(known, F.col("block_type")).otherwise(F.raise_error(F.lit("a block is of no known type")))
        rows = script.withColumn("block_type", kind).filter(~T.is_blank(F.col("text"))).withColumn("_packed", packed)
        rows = rows.withColumn("_chunks", F.when(over, F.raise_error(F.lit("a word is over the budget and can't be cut"))).otherwise(F.col("_packed.chunks")))
    else:
        rows = script.withColumn("_known", known).filter(~F.col("_known") | ~T.is_blank(F.col("text"))).withColumn("_packed", packed)
        faulty = F.max(~F.col("_known") | over).over(Window.partitionBy("doc_id"))
        rows = rows.withColumn("_faulty", faulty).filter(~F.col("_faulty")).withColumn("_chunks", F.col("_packed.chunks"))
    return rows.withColumn("_n", F.size("_chunks")).select(
        "doc_id", "block_index", F.posexplode("_chunks").alias("part", "chunk"), "_n", "block_type", "speaker"
    ).select("doc_id", "block_index", "part", F.col("chunk").alias("text"), (F.col("part") == F.col("_n") - 1).alias("paragraph_end"), "block_type", "speaker")


def build_chunks(script: DataFrame, budget: int = BUDGET, counter: str | Counter = "chars4", strict: bool = False) -> DataFrame:
    """doc_id, block_index, part (place in its block), text, paragraph_end, block_type, speaker.

    ``counter``: a named one, a udf, pandas_udf or arrow_udf, or a function from column to
    column. Documents with a block of unknown type or a word over the budget are left out whole;
    quarantine() says which and why; ``strict`` makes them an error.
    """
    validate_script(script, budget)
    return _rows(script, _packed(F.col("text"), budget, counter), strict)


def _plan(script: DataFrame, budgets: Mapping[str, int] | int, counters: Mapping[str, str | Counter] | None) -> dict[str, tuple[int, str | Counter]]:
    """Budget and counter of each role."""
    plan = {role: (budgets if isinstance(budgets, int) else budgets[role], (counters or {}).get(role, "chars4")) for role in ("narration", "quote")}
    for budget, _ in plan.values():
        validate_script(script, budget)
    return plan


def build_role_chunks(script: DataFrame, budgets: Mapping[str, int] | int = BUDGET, counters: Mapping[str, str | Counter] | None = None, strict: bool = False) -> DataFrame:
    """Chunks of both roles, each with its own budget and counter, numbered from 1 in document order as chunk_index.

    One pass over the script: the role picks the expression. Faulty documents are left
    out as in build_chunks().
    """
    plan = _plan(script, budgets, counters)
    quote, one, other = F.col("block_type").eqNullSafe("quote"), plan["narration"], plan["quote"]
    if one == other:
        rows = build_chunks(script, *one, strict)
    else:
        # each counter gets the texts of its role only
        rows = _rows(script, F.coalesce(_packed(F.when(quote, F.col("text")), *other), _packed(F.when(~quote, F.col("text")), *one)), strict)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_index", "part"))
    return rows.withColumn("role", F.when(quote, "quote").otherwise("narration")).withColumn("chunk_index", number).drop("part")


def quarantine(script: DataFrame, budgets: Mapping[str, int] | int = BUDGET, counters: Mapping[str, str | Counter] | None = None) -> DataFrame:
    """doc_id, block_index, reason, preview, tokens: why build_role_chunks() leaves documents out, a row for each fault.

    preview and tokens are those of a word over its role's budget, null for other faults.
    """
    plan = _plan(script, budgets, counters)
    unknown = validate_script(script)[1].select("doc_id", "block_index", "reason", F.lit(None).cast("string").alias("preview"), F.lit(None).cast("int").alias("tokens"))
    quote, one, other = F.col("block_type") == "quote", plan["narration"], plan["quote"]
    known = script.filter(F.col("block_type").isin(*TYPES))
    # a pass for each counter
    for own, (budget, counter) in [(known, one)] if one == other else [(known.filter(~quote), one), (known.filter(quote), other)]:
        words = oversized_words(own, budget, counter)
        unknown = unknown.unionByName(words.select("doc_id", "block_index", F.lit("a word is over the budget").alias("reason"), "preview", F.col("tokens").cast("int").alias("tokens")))
    return unknown


def audit_budget(chunks: DataFrame, budget: int = BUDGET, counter: str | Counter = "chars4") -> DataFrame:
    """Chunks over the budget: doc_id, block_index, tokens, preview; none, if all is well."""
    tokens = T.token_count(F.col("text"), counter)
    return chunks.withColumn("tokens", tokens).filter(F.col("tokens") > budget).select("doc_id", "block_index", "tokens", F.substring("text", 1, 70).alias("preview"))


def reassemble(chunks: DataFrame, order: str = "part") -> DataFrame:
    """doc_id, block_index, text: a block's chunks joined by spaces, its normalised text again."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col("text").alias("t"))))
    return chunks.groupBy("doc_id", "block_index").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))
