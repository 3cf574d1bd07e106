"""Roles and reference recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.functions import text as T
from cadenza.operators.script import TYPES

ROLES = ("narration", "quote")
#: Block type, role, extra pause before and after in ms.
SETTINGS = (("paragraph", "narration", 0, 0), ("heading", "narration", 0, 0), ("list", "narration", 0, 0), ("quote", "quote", 250, 250))


def role_settings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(SETTINGS, "block_type string, role string, extra_lead_pause_ms int, extra_trail_pause_ms int")


def with_role(df: DataFrame, strict: bool = False) -> DataFrame:
    """Role and extra pauses of every row; an unknown type has none (``strict``: is an error). The dimension has four rows."""
    out = df.drop("role").join(F.broadcast(role_settings(df)), "block_type", "left")
    if strict:
        out = out.withColumn("role", F.coalesce("role", F.raise_error(F.concat(F.lit("no role for blocks of type "), F.coalesce("block_type", F.lit("null")))).cast("string")))
    return out


def required_roles(script: DataFrame) -> DataFrame:
    """doc_id, roles: those with text, narration first."""
    own = F.when(F.col("block_type") == "quote", "quote").otherwise("narration")
    rows = script.filter(~T.is_blank(F.col("text")) & F.col("block_type").isin(*TYPES)).groupBy("doc_id").agg(F.collect_set(own).alias("s"))
    return rows.select("doc_id", F.filter(F.array(*map(F.lit, ROLES)), lambda r: F.array_contains("s", r)).alias("roles"))


def route_references(roles: DataFrame, mode: str, narration_ref: str | None, quote_ref: str | None) -> DataFrame:
    """doc_id, role, path: quotes use the second recording in two_voice mode only."""
    second = (F.col("role") == "quote") & F.lit(mode == "two_voice")
    return roles.select("doc_id", F.explode("roles").alias("role")).withColumn("path", F.when(second, F.lit(quote_ref)).otherwise(F.lit(narration_ref)))


def validate_references(routed: DataFrame, assets: DataFrame) -> DataFrame:
    """``routed`` with sha256 and reason (null if the recording serves); ``assets``: path, sha256, frames, sample_rate."""
    known = assets.withColumn("_found", F.lit(True))
    bad = (F.coalesce("frames", F.lit(0)) <= 0) | (F.coalesce("sample_rate", F.lit(0)) <= 0)
    reason = (
        F.when(F.coalesce("path", F.lit("")) == "", F.concat(F.lit("no recording is named for the voice of the "), "role"))
        .when(F.col("_found").isNull(), F.concat(F.lit("there is no such recording for the voice of the "), "role"))
        .when(bad, F.concat(F.lit("nothing is on the recording for the voice of the "), "role"))
    )
    return routed.join(known.hint("shuffle_merge"), "path", "left").select("doc_id", "role", "path", "sha256", reason.alias("reason"))


def reject_identical_references(validated: DataFrame, mode: str, hash_col: str = "sha256") -> DataFrame:
    """doc_id, reason of documents whose two voices come from one recording; also for anchors' hashes."""
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    both = validated.groupBy("doc_id").agg(pick("narration", "path").alias("p0"), pick("quote", "path").alias("p1"), pick("narration", hash_col).alias("h0"), pick("quote", hash_col).alias("h1"))
    same = F.lit(mode == "two_voice") & ((F.col("p0") == F.col("p1")) | (F.col("h0") == F.col("h1")))
    return both.filter(same).select("doc_id", F.lit("both voices come from one recording").alias("reason"))
