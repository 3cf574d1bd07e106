"""Intake: checking requests, and planning only what is new as posts arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.functions import text as T
from cadenza.operators import cache, chunk, extract, script
from cadenza.sources.shared import make_folder, written


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with text, and blank ones with a reason; a batch or a stream."""
    blank = T.is_blank(F.col("text"))
    return requests.filter(~blank), requests.filter(blank).withColumn("reason", F.lit("there is no text"))


def plan_pages(pages: DataFrame, models: DataFrame, voices: DataFrame, mode: str = "preserve") -> DataFrame:
    """Posts to keyed chunks: doc_id, chunk_index, role, text, seed, cache_key, payload_json, ..."""
    return plan_script(script.build_script(extract.extract_blocks(pages), mode), models, voices)


def plan_script(told: DataFrame, models: DataFrame, voices: DataFrame) -> DataFrame:
    return cache.payload_key(cache.generation_payload(cache.assign_seeds(chunk.build_role_chunks(told)), models, voices))


ASKED = "cache_key string, doc_id long, chunk_index int, role string, text string, seed long, payload_json string"


COMPACT_ROWS = 1 << 14  # rows that a task of _first_rows() takes up before it drops those that aren't first
FIRST = [("cache_key", "ascending"), ("done", "descending"), ("doc_id", "ascending"), ("chunk_index", "ascending")]


def _firsts(rows: pa.Table) -> pa.Table:
    """A row for each key: one that is done, or else the first post and place that wants it; null comes first."""
    rows = rows.take(pc.sort_indices(rows.select([name for name, _ in FIRST]), sort_keys=FIRST, null_placement="at_start"))
    key = rows.column("cache_key").combine_chunks()
    before, own = key.slice(0, max(len(key) - 1, 0)), key.slice(1)
    differs = pc.fill_null(pc.not_equal(before, own), pc.xor(pc.is_null(before), pc.is_null(own)))
    return rows.filter(pa.concat_arrays([pa.array([True] * min(len(key), 1), pa.bool_()), differs]))


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_firsts() of a task's rows; it holds about twice what it gives."""
    kept, more, held = [], [], 0
    for batch in batches:
        more.append(batch)
        held += batch.num_rows
        if held >= max(COMPACT_ROWS, sum(b.num_rows for b in kept)):
            kept, more, held = _firsts(pa.Table.from_batches([*kept, *more])).to_batches(), [], 0
    if kept or more:
        yield from _firsts(pa.Table.from_batches([*kept, *more])).to_batches(max_chunksize=1 << 13)


def new_keys(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Stream of the rows of ``wanted`` (with cache_key) whose key comes for the first time, in neither of the two streams before.

    The keys seen are the state of the stream, so a batch reads what has arrived and not
    what was asked for before. A key that arrives as done and as wanted in one batch is done.
    Each task first leaves one row for each of its keys; then Spark's own deduplication knows the keys of earlier batches.
    """
    names = [f.split(" ")[0] for f in ASKED.split(", ")]
    rows = wanted.select(*names, F.lit(False).alias("done"))
    both = rows.unionByName(done.select("cache_key", F.lit(True).alias("done")), allowMissingColumns=True)
    one = both.repartition("cache_key").mapInArrow(_first_rows, f"{ASKED}, done boolean")
    return one.dropDuplicates(["cache_key"]).filter("NOT done").drop("done")


def resume_stream(spark: SparkSession, pages: DataFrame, models: DataFrame, voices: DataFrame, done_path: str, todo_path: str, checkpoint: str, bad_path: str | None = None) -> StreamingQuery:
    """Append to ``todo_path`` the chunks of arriving posts whose key is neither done nor already asked for.

    Two streams, each until what is there has been read: posts to keyed chunks, a folder
    for each batch that is written anew if the batch runs again; then the keyed chunks and
    what arrives in ``done_path`` to new_keys(). The second one is returned.
    A key that several posts of a batch want is asked for with the first of them.
    Posts that can't be narrated go to ``bad_path`` with a reason, if it is given.
    """
    planned = f"{checkpoint.rstrip('/')}/planned"

    def batch(rows: DataFrame, number: int) -> None:
        blocks = written(extract.extract_blocks(rows), "blocks")
        told = script.build_script(blocks)
        if bad_path is not None:
            chunk.quarantine(told).unionByName(extract.rejected_pages(rows, blocks), allowMissingColumns=True).write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        plan_script(told, models, voices).select(*[f.split(" ")[0] for f in ASKED.split(", ")]).write.mode("overwrite").parquet(f"{planned}/batch={number}")

    pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/posts").trigger(availableNow=True).start().awaitTermination()
    for path in (done_path, planned):
        make_folder(spark, path)
    read = lambda schema, path: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    todo = new_keys(read(ASKED, planned), read("cache_key string", done_path))
    return todo.writeStream.format("parquet").option("path", todo_path).option("checkpointLocation", f"{checkpoint}/keys").trigger(availableNow=True).start()
