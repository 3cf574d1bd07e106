"""Exact dedup through content-defined chunk recipes.

A text, white space collapsed, is cut where a rolling hash of its last 16 bytes
hits a fixed pattern, so equal texts are cut alike and long shared passages give
shared chunks. A chunk's identifier is its 64-bit hash, verified over the whole
corpus: grouping by (hash, chunk bytes) shows which hashes stand for more than
one chunk. Each document becomes its recipe, the ordered list of identifiers,
and documents are compared by recipe alone; the texts themselves are moved once,
chunk by chunk, with equal chunks combined before the shuffle. A recipe that
holds an identifier that is not unique (a hash collision) is compared together
with the SHA-256 of the text, which makes it exact again.

Defined results: null text is the empty text; the empty text has one empty
chunk, so all empty texts are equal; rows that repeat a doc_id are kept as rows
and counted in ``group_size``; a null doc_id never wins over a number; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

WINDOW, LEAST, MOST, MASK = 16, 512, 16384, 0x7FF  # bytes; the mean is LEAST + MASK + 1
_GEAR = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def cut_points(flat: np.ndarray) -> np.ndarray:
    """Places after whose byte the rolling hash would allow a cut."""
    if len(flat) < WINDOW:
        return np.zeros(0, np.int64)
    gear = _GEAR[flat]
    rolled = gear.copy()
    for back in range(1, WINDOW):
        rolled[back:] += gear[:-back] << np.uint32(back)
    # bits 16-26 depend on all the bytes of the window and on none before it
    return np.flatnonzero(((rolled >> np.uint32(WINDOW)) & np.uint32(MASK)) == 0) + 1


def chunk_ends(flat: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; a pure function of its bytes."""
    n, points, ends, at = len(flat), cut_points(flat), [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(points, at + LEAST))
        at = min(int(points[k]) if k < len(points) else n, at + MOST)
        ends.append(at)
    if at < n or not ends:
        ends.append(n)
    return ends


def _recipes(batches):
    for batch in batches:
        column = batch.column("norm")
        ids, chunks = [], []
        for _, offsets, flat in common.text_slices(column):
            for a, b in zip(offsets[:-1], offsets[1:]):
                own = flat[a:b]
                start, hs, parts = 0, [], []
                for end in chunk_ends(own):
                    part = own[start:end].tobytes()
                    parts.append(part)
                    hs.append(xxhash.xxh3_64_intdigest(part) - (1 << 63))
                    start = end
                ids.append(hs)
                chunks.append(parts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_sha256"), pa.array(ids, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.binary()))],
            ["doc_id", "text_sha256", "recipe", "chunks"],
        )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal once runs of white space are one space.

    Returns doc_id, keep_id (smallest id of the group), group_size, kept,
    text_sha256 for every row of ``docs``.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    cut = texts.mapInArrow(_recipes, "doc_id long, text_sha256 string, recipe array<long>, chunks array<binary>")
    cut = common.stored(cut)
    # Chunk dedup: a row for each distinct chunk, then the hashes that more than one chunk has.
    pairs = cut.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("c")).groupBy(F.col("c.recipe").alias("h"), F.col("c.chunks").alias("chunk")).agg(F.lit(1).alias("one"))
    shared = common.stored(pairs.groupBy("h").count().filter("count > 1").select("h"))
    rows = cut.select("doc_id", "text_sha256", "recipe")
    if shared.isEmpty():
        rows = rows.withColumn("tie", F.lit(""))
    else:
        flagged = rows.select("text_sha256", F.explode("recipe").alias("h")).join(shared.hint("shuffle_merge"), "h", "left_semi").select("text_sha256").distinct().withColumn("hit", F.lit(True))
        rows = rows.join(flagged.hint("shuffle_merge"), "text_sha256", "left").withColumn("tie", F.when(F.col("hit"), F.col("text_sha256")).otherwise("")).drop("hit")
    # written, so that the join's sides come straight from their shuffles and Spark can split a large group
    groups = common.stored(rows.groupBy("recipe", "tie").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return rows.join(groups.hint("shuffle_merge"), ["recipe", "tie"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
