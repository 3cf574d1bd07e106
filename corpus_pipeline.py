"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes all that its predecessor kept, is written as Parquet and read
back, and hands the columns of ``documents`` on. Columns beyond those pass through
the first four stages. The last one returns doc_id, lang, source, ids, n_tokens and
round_trip only: token ids stand for the text from there on.

Defined results: rows that share a doc_id are documents of their own as long as their
texts differ; of rows that share both, near-dedup keeps one. Near-dedup keeps rows
without a doc_id. A null language is filled with the one that language ID found, so
mixing weighs the document under it; a given language is not overruled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm import bpe, common, language_id, line_dedup, mixing, near_dedup

LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts whose language is in doubt, go; a null language becomes the one found."""
    docs, back = common.aside(docs, "lang_pred", "lang_score")
    scored = language_id.predict(docs, language_id.train(docs))
    keep = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)
    return scored.filter(keep).withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "lang_score").withColumnsRenamed(back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go; so do documents of which nothing but white space is left."""
    docs, back = common.aside(docs, "_n_lines", "_n_removed")
    done = line_dedup.line_dedup(docs)
    keep = (F.col("_n_removed") == 0) | F.col("text").rlike(r"\S")
    return done.filter(keep).withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).drop("_n_lines", "_n_removed").withColumnsRenamed(back)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    columns = docs.columns
    docs, back = common.aside(docs, "text_hash")
    dropped = common.stored(near_dedup.near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id", "text_hash").distinct())
    marked = docs.withColumn("text_hash", near_dedup.text_hash("doc_id", "text"))
    left = marked.join(dropped.hint("shuffle_merge"), ["doc_id", "text_hash"], "left_anti").dropDuplicates(["doc_id", "text_hash", "text"])
    return left.drop("text_hash").withColumnsRenamed(back).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights."""
    docs, back = common.aside(docs, "_topic", "_n_tokens", "_weight", "_probability", "_kept")
    return mixing.mix(docs).filter("_kept").select(*docs.columns).withColumnsRenamed(back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    coded = bpe.encode(docs, decoded="decoded")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: SQL cannot express the first, fourth and fifth stage; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{at}.parquet"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
