"""The manifest table: whole versions, only touched buckets, lookups that don't move it."""

import datetime
import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from cadenza.operators import cache
from cadenza.sources.manifests import ManifestTable, may_have

SCHEMA = "cache_key string, value int, created_utc timestamp"


def rows(spark, *items):
    return spark.createDataFrame([(k, v, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)) for k, v, t in items], SCHEMA)


def held(table):
    return {r.cache_key: r.value for r in table.read().collect()}


def test_changes_are_versions(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path), buckets=8)
    assert table.read() is None and table.lookup(rows(spark, ("a", 1, 1))) is None and table.upsert(rows(spark)) == 0
    assert table.upsert(rows(spark, *((f"k{i}", i, 1) for i in range(50)))) == 1
    assert table.upsert(rows(spark, ("k1", 100, 2), ("k2", 200, 0), ("new", 7, 1), ("new", 8, 3))) == 2
    assert held(table) == {f"k{i}": i for i in range(50)} | {"k1": 100, "new": 8}
    assert ManifestTable(spark, str(tmp_path), buckets=999).version()["buckets"] == 8
    with_more = rows(spark, ("k3", 333, 5)).withColumn("more", F.lit("x"))
    table.upsert(with_more)
    assert {r.cache_key: r.more for r in table.read().filter("value IN (333, 4)").collect()} == {"k3": "x", "k4": None}


def test_a_small_change_to_many_buckets_writes_only_its_own(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path), buckets=300)
    table.upsert(rows(spark, *((f"k{i}", i, 1) for i in range(3000))))
    before = table.version()["folders"]
    table.upsert(rows(spark, ("k5", -5, 2), ("k77", -77, 2)))
    after = table.version()["folders"]
    changed = {b for b in after if before.get(b) != after[b]}
    assert len(changed) <= 2 and len(after) == len(before) > 250
    assert len(list((tmp_path / "data" / after[min(changed)].split("/")[1]).glob("bucket=*"))) == len(changed)
    assert table.read().count() == 3000 and held(table)["k77"] == -77


def test_a_job_that_fails_leaves_the_last_version(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path), buckets=4)
    table.upsert(rows(spark, ("a", 1, 1), ("b", 2, 1)))
    broken = rows(spark, ("a", 9, 9)).withColumn("value", F.when(F.col("value") == 9, F.raise_error(F.lit("lost"))).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert table.version()["number"] == 1 and held(table) == {"a": 1, "b": 2}


def test_changes_at_once_are_all_kept(spark, tmp_path):
    tables = [ManifestTable(spark, str(tmp_path), buckets=4) for _ in range(4)]
    threads = [threading.Thread(target=t.upsert, args=(rows(spark, (f"own{n}", n, 1), ("all", n, n)),)) for n, t in enumerate(tables)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert tables[0].version()["number"] == 4 and held(tables[0]) == {f"own{n}": n for n in range(4)} | {"all": 3}


def test_lookups_give_all_wanted_and_few_others(spark, tmp_path):
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    table = ManifestTable(spark, str(tmp_path), buckets=16)
    table.upsert(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"), F.col("id").cast("int").alias("value"), F.current_timestamp().alias("created_utc")))
    wanted = spark.createDataFrame([(key(i),) for i in [*range(0, 5000, 50), 9999]] + [(None,)], "k string")
    got = {r.value for r in table.lookup(wanted, "k").collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 110
    one = table.lookup(spark.createDataFrame([(key(3),)], "cache_key string"))
    assert len({f.rpartition("bucket=")[2].partition("/")[0] for f in one.inputFiles() if "bucket=" in f}) == 1


def test_classifying_what_a_lookup_found_is_classifying_all(spark, tmp_path):
    stems = [f"s{i}" for i in range(200)]
    manifests = spark.createDataFrame([(s, f"p{s}" if i % 3 else "{}", "x", 5, "FLOAT", 1, 24000, 5 if i % 4 else 4, "x", True) for i, s in enumerate(stems)], "file_stem string, payload_json string, wav_sha256 string, frames long, subtype string, channels int, rate int, actual_frames long, actual_sha256 string, finite boolean").withColumn("created_utc", F.current_timestamp())
    table = ManifestTable(spark, str(tmp_path), buckets=8, key="file_stem")
    table.upsert(manifests)
    plan = spark.createDataFrame([(s, f"p{s}") for s in [*stems[::7], "gone"]], "file_stem string, payload_json string")
    status = lambda m: {r.file_stem: r.status for r in cache.classify_cache(plan, m, 24000).collect()}
    assert status(table.lookup(plan).drop("created_utc")) == status(manifests.drop("created_utc"))
    pruned = cache.classify_cache(plan, may_have(table.read(), plan.select("file_stem"), "file_stem").drop("created_utc"), 24000)
    text = pruned._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and text.index("SortMergeJoin") < text.index("BroadcastHashJoin")  # pruned before the exchange of the join
