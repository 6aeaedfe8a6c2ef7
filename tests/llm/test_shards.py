"""The law of shards recomputed, order and bounds of buckets."""

from __future__ import annotations

import struct

import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import sharding
from sparkloom.session import scratch


def chained(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q" if v[1] == "long" else "<i", v[0]), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def shard(doc_id, shards, seed):
    return max((chained((doc_id, "long"), (seed, "int"), (s, "int")), s) for s in range(shards))[1]


def digests(spark, docs, **kind):
    return sorted(map(tuple, sharding.shard_digests(docs, scratch(spark, "shards-law"), **kind).collect()))


def test_law_recomputed(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    for r in digests(spark, docs, seed=5):
        assert r[3:5] == ("key", shard(r[0], 24, 5)) and r[6] == shard(r[0], 25, 5)


def written(spark, docs, seed, bucket_bytes):
    path = scratch(spark, "shards-order")
    sharding.write_shards(docs, path, 3, seed, bucket_bytes)
    rows = sharding.read_shards(spark, path, docs.schema).select("shard", "slot", "record.*").collect()
    raw = spark.read.parquet(path).groupBy("shard", "bucket").count().collect()
    return sorted(map(tuple, rows)), raw


def test_slots_follow_from_seed_and_bucket(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id") % 7).alias("text"))
    first, raw = written(spark, docs, 1, 2000)
    assert len(raw) > 9
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert written(spark, docs.repartition(13, "text"), 1, 2000)[0] == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    other, _ = written(spark, docs, 2, 2000)
    assert other != first
    order = [r[2] for r in first if r[0] == 0]
    assert order != sorted(order) and sum(a < b for a, b in zip(order, order[1:])) < 0.6 * len(order)


def test_repeated_rows_are_dealt_to_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 64)
    rows = [(7, "same text")] * 1000 + [(None, None)] * 300 + [(8, f"t{i}") for i in range(300)] + [(i, "") for i in range(100, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("x"))
    got, raw = written(spark, docs, 3, 1000)
    assert sorted(map(str, (r[2:4] for r in got))) == sorted(map(str, rows))
    assert max(r["count"] for r in raw) < 250
    for s in range(3):
        slots = sorted(r[1] for r in got if r[0] == s)
        assert slots == list(range(len(slots)))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "long " * 400_000), (2, "short"), (3, None)], "doc_id long, text string")
    assert sorted(r[1] for r in digests(spark, docs)) == [8, 13, 2_000_008]


def test_records_are_not_shuffled_to_meet_their_bases(spark):
    path, docs = scratch(spark, "shards-plan"), spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    sharding.write_shards(docs, path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = sharding.read_shards(spark, path, docs.schema)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
