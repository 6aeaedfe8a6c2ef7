"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters records by seeded hashes: highest-random-weight hashing of doc_id picks the shard (law ``key``:
a further shard takes records only into itself), a second hash picks one of the shard's buckets, which are as many
as keep a bucket at about ``bucket_bytes``. The scattered records lie in Spark's shuffle files, a partition a bucket. Pass two orders
each bucket by key, permutes it with a seeded Fisher-Yates shuffle (Spark's ``shuffle``, whose draws follow from the seed
and the partition, that is the bucket, alone) and writes it. A record's slot is its bucket's base in the shard plus its
place in the bucket. So the same table, seed and bucket size give the same slots however the input is partitioned, and when a
task runs again.

Null text counts as 0 bytes. Rows with equal or null doc_id share a shard but are dealt to its buckets by text; if they are more
than a bucket holds, rows equal in all columns are counted first and dealt by their number. Every
row keeps a slot of its own. Extra columns travel in the struct ``record`` whatever their names are (maps can't be
ordered and aren't supported). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.session import materialize

SHARDS = 24
#: Text of a bucket, which one task sorts in memory; it needs a few times as much.
BUCKET_BYTES = 32 << 20
#: Copies of a row that one task makes.
COPIES = 100_000


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash of ``doc_id`` is highest."""
    return F.array_max(F.array(*(F.struct(F.xxhash64(doc_id, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards))))["s"]


def _numbered(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """``rows`` (k, t, r, copy) with the number of its copy for each row whose k is crowded. Equal rows are counted before they are
    shuffled, and tasks make their copies ``COPIES`` at a time."""
    same = F.col("k").eqNullSafe(F.col("_id"))
    counts = rows.join(crowded, same, "left_semi").groupBy("k", "t", "r").agg(F.count("*").alias("n"))
    begun = counts.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition("k", "t", "first")
    copies = F.explode(F.sequence("first", F.least(F.col("first") + COPIES, "n") - 1))
    return rows.join(crowded, same, "left_anti").union(begun.select("k", "t", "r", copies.alias("copy")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write ``docs`` (doc_id, text and more) below ``path`` as Parquet: shard=N folders of rows (bucket, place, record)."""
    size = record_size(F.col("text"))
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    rows = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.lit(0).cast("long").alias("copy"))
    # ids that alone overflow a bucket: as many as there are buckets at most
    crowded = materialize(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.sum(size).alias("_n")).where(F.col("_n") > bucket_bytes).select("_id"), "shards-crowded")
    if not crowded.isEmpty():
        rows = _numbered(rows, crowded)
    bucket = F.pmod(F.xxhash64("k", "t", "copy", F.lit(seed + 1)), F.lit(buckets))
    dealt = rows.select((shard_of(F.col("k"), shards, seed) * F.lit(buckets) + bucket).cast("int").alias("g"), F.struct("k", "r").alias("item"))
    full = dealt.repartitionById(shards * buckets, "g").groupBy("g").agg(F.sort_array(F.collect_list("item")).alias("items"))
    mixed = full.select("g", F.posexplode(F.shuffle("items", seed)).alias("place", "item"))
    shard, bucket = F.floor(F.col("g") / buckets).cast("int"), (F.col("g") % buckets).cast("int")
    mixed.select(shard.alias("shard"), bucket.alias("bucket"), "place", F.col("item.r").alias("record")).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """The written rows, ``record`` being their columns, with their slot: shard, slot, record."""
    schema = StructType().add("bucket", "integer").add("place", "integer").add("record", record).add("shard", "integer")
    rows = spark.read.schema(schema).parquet(path)
    # one row a bucket; the window runs over a shard's buckets
    sizes = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # a row a bucket, that is a file, goes to all; else the records would be shuffled a second time to meet them
    return rows.join(F.broadcast(bases), ["shard", "bucket"]).select("shard", (F.col("base") + F.col("place")).alias("slot"), "record")


def shard_digests(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Write shards, read them back: doc_id, size, text_crc32, law, shard, slot, grown_shard of each record."""
    write_shards(docs.select("doc_id", "text"), path, shards, seed)
    rows = read_shards(docs.sparkSession, path, docs.select("doc_id", "text").schema)
    text = F.col("record.text")
    return rows.select(
        F.col("record.doc_id").alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        shard_of(F.col("record.doc_id"), shards + 1, seed).alias("grown_shard"),
    )
