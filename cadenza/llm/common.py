"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and
    the session is local (tests, a laptop) a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage in a way that outlives any executor, and gives Spark
    the true size of the table for its later joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename the columns whose names an operator needs for itself; returns the table and how to rename them back."""
    taken = {n.lower() for n in names}
    away = {c: f"{c}__{uuid.uuid4().hex[:8]}" for c in df.columns if c.lower() in taken}
    return df.withColumnsRenamed(away), {v: k for k, v in away.items()}


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written in decimal, modulo ``folds``; null ids fall in no fold."""
    return F.crc32(doc_id.cast("string")) % folds


def unit_hash(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def text_slices(column: pa.Array, most_bytes: int = 1 << 19):
    """Cut an Arrow string column into runs of rows of about ``most_bytes``.

    Yields (first row, offsets, bytes): the UTF-8 bytes of the run's texts in
    one flat array, text k of it at offsets[k]:offsets[k + 1]. Null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, offsets[row : end + 1] - offsets[row], flat[offsets[row] : offsets[end]]
        row = end


class Numbers(dict):
    """A number for everything asked for, in order from 0 on."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the elements of several runs of a flat array, run after run."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
