"""Reading posts and manifests, writing plans and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadenza.sources.shared import content, listed, put_if_absent, written

#: How numbered results are named.
PREFIX, WIDTH = "narration", 4
NAME = rf"(?i)^{PREFIX}_(\d+)\.wav$"
MANIFEST = "cache_key string, payload_json string, wav_sha256 string, subtype string, frames bigint, sample_rate int, channels int, created_utc timestamp"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html of a Parquet table of posts; for raw files see read_html_files."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """url (the file) and html, a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def fingerprint(df: DataFrame, col: str, to: str = "sha256") -> DataFrame:
    """SHA-256 of a text's UTF-8 (or of a binary column)."""
    return df.withColumn(to, F.sha2(F.col(col), 256))


def fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests from JSON files, a manifest to a line; what can't be read counts as absent."""
    rows = spark.read.schema(MANIFEST + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter(F.col("_corrupt_record").isNull() & F.col("cache_key").isNotNull()).drop("_corrupt_record")


def write_manifests(manifests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All files appear together when the job commits, or none does."""
    manifests.write.mode(mode).json(path)


def write_plan(plan: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each role; a document's rows of a role lie together and in order."""
    plan.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index").write.mode(mode).partitionBy("role").parquet(path)


def padded(number: str | Column) -> Column:
    """WIDTH digits, or all that a longer number has (lpad alone would cut it)."""
    digits = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.when(F.length(digits) < WIDTH, F.lpad(digits, WIDTH, "0")).otherwise(digits)


def reserve_numbers(spark: SparkSession, folder: str, count: int, taken: int = 0) -> int:
    """The first of ``count`` numbers above ``taken`` that no other run has or gets.

    A run claims its range by a file in the folder .numbers, named by the range's first
    number and made only if it is not there; who loses the race reads the last claim again.
    Claims follow each other, so every number is used or in the claim of a run that failed.
    """
    if count < 1:
        return taken + 1
    while True:
        claimed = max((int(name.removeprefix("claim-")) for name in listed(spark, f"{folder}/.numbers", "claim-*")), default=None)
        end = 0 if claimed is None else claimed + int(content(spark, f"{folder}/.numbers/claim-{claimed}")) - 1
        first = max(taken, end) + 1
        if put_if_absent(spark, f"{folder}/.numbers/claim-{first}", str(count)):
            return first


def allocate_output_numbers(new_docs: DataFrame, existing: DataFrame, id_col: str = "doc_id", name_col: str = "name", folder: str | None = None) -> DataFrame:
    """doc_id, number, name: the next numbers after the largest one in use, in order of doc_id.

    With the ``folder`` of the outputs, the numbers are reserved there against other runs
    that number at the same time.

    Ids are numbered without bringing them to one task: they are sorted into ranges
    and written with their range and their place in it, the written ranges are
    counted, and a row's number is its range's offset and its place. (Ranges are
    drawn from a sample, so they would not be the same if they were made twice.)
    A null id comes first; an id that repeats gets a number for each of its rows.
    """
    taken = existing.agg(F.coalesce(F.max(F.regexp_extract(name_col, NAME, 1).try_cast("bigint")), F.lit(0))).first()[0]
    ordered = new_docs.select(F.col(id_col).alias("doc_id")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    numbered = ordered.withColumn("_m", F.monotonically_increasing_id())
    placed = written(numbered.select("doc_id", F.shiftright("_m", 33).cast("int").alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_i")), "numbers")
    sizes = sorted(placed.groupBy("_p").count().collect())  # a row for each range
    if folder is not None:
        taken = reserve_numbers(new_docs.sparkSession, folder, sum(n for _, n in sizes), taken) - 1
    offsets, total = [], taken
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    starts = placed.sparkSession.createDataFrame(offsets, "_p int, _start long")
    number = F.col("_start") + F.col("_i") + 1
    # no more rows than the sort had partitions
    return placed.join(F.broadcast(starts), "_p").select("doc_id", number.alias("number"), F.concat(F.lit(f"{PREFIX}_"), padded(number), F.lit(".wav")).alias("name"))
