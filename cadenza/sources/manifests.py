"""A table of manifests that is changed in place: buckets by key, versions, one pointer.

    folder/data/<run>/bucket=<b>/...   rows of a bucket, sorted by key
    folder/versions/<number>.json      which folder each bucket has in that version

A change writes the buckets that it touches anew, beside what is there, and then adds
the next version's file, which is made only if it is not there. So a reader sees
whole versions, a job that fails leaves the last one as it was, and of two changes at
once the one that comes second begins again from what the first has made.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cadenza.operators.cache import upsert_manifests
from cadenza.sources.shared import content, listed, put_if_absent, written

BITS = 24  # 2 ** BITS bits say which keys a lookup may want


class ManifestTable:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256, key: str = "cache_key", at: str = "created_utc") -> None:
        """``buckets`` is that of the first version; later it stays what it was then."""
        self.spark, self.folder, self.first_buckets, self.key, self.at = spark, folder.rstrip("/"), buckets, key, at

    def version(self) -> dict:
        """number, buckets, schema and folders of the last version; number 0 where there is none."""
        names = listed(self.spark, f"{self.folder}/versions", "[0-9]*.json")
        if not names:
            return {"number": 0, "buckets": self.first_buckets, "schema": None, "folders": {}}
        return json.loads(content(self.spark, f"{self.folder}/versions/{max(names)}"))

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def read(self, buckets: set[int] | None = None, version: dict | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None where nothing was ever written."""
        now = version or self.version()
        if now["schema"] is None:
            return None
        schema = StructType.fromJson(now["schema"])
        paths = [f"{self.folder}/{path}" for b, path in sorted(now["folders"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, new: DataFrame) -> int:
        """The last written row of every key, old and new; returns the number of the version that has it.

        Only the buckets of the new keys are read and written.
        """
        while True:
            now = self.version()
            rows = written(new.withColumn("_bucket", self.bucket(now["buckets"])), "upsert")
            touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # no more than there are buckets
            if not touched:
                return now["number"]
            old, rows = self.read(touched, now), rows.drop("_bucket")
            merged = upsert_manifests(rows.limit(0) if old is None else old, rows, self.key, self.at)
            path = f"data/{uuid.uuid4().hex}"
            merged.withColumn("bucket", self.bucket(now["buckets"])).repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
            folders = now["folders"] | {str(b): f"{path}/bucket={b}" for b in touched}
            then = now | {"number": now["number"] + 1, "schema": json.loads(merged.schema.json()), "folders": folders}
            if put_if_absent(self.spark, f"{self.folder}/versions/{then['number']:012d}.json", json.dumps(then)):
                return then["number"]

    def lookup(self, wanted: DataFrame, key: str | None = None) -> DataFrame | None:
        """The rows of the wanted keys and few others: of their buckets, what a bitmap of the keys lets through.

        For a join with the keys: what that has to move is about as many rows as it finds,
        not the table. The bitmap has a fixed size (512 rows of 4 KB), so every task may have it.
        """
        now = self.version()
        keys = written(wanted.select(F.col(key or self.key).alias(self.key)).filter(F.col(self.key).isNotNull()).distinct(), "keys")
        touched = {r[0] for r in keys.select(self.bucket(now["buckets"])).distinct().collect()}
        rows = self.read(touched, now)
        return None if rows is None else may_have(rows, keys, self.key)


def may_have(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key's bit is set in the bitmap of the ``keys``: all that have one of them, and few others while the keys are fewer than the bits."""
    place = F.xxhash64(key).bitwiseAND((1 << BITS) - 1)
    bits = keys.groupBy(F.shiftright(place, 15).alias("_part")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("_bits"))
    spot = place.bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(spot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_part", F.shiftright(place, 15)).join(F.broadcast(bits), "_part")
    return found.filter(F.call_function("bit_get", byte, spot.bitwiseAND(7)) == 1).drop("_part", "_bits")
