"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly over buckets that fit in memory, by a
seeded hash of the record number, so that neither a hot key nor equal texts make
a bucket large. Pass 2 shuffles each bucket by Fisher-Yates (Spark's seeded
``shuffle``) and writes it. Bucket after bucket, that is one random order of all
records, which is cut into shards whose row counts are at most one apart.

Everything here is built-in functions; nothing is collected but two totals.

Defined results: a null text has size 1 and checksum 0; repeated rows are separate
records; an empty table gives no rows; every column is carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprobe.session import materialize

SEED = 42
BUCKET_BYTES = 16 << 20
MAX_BROADCAST_BUCKETS = 100_000


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint")


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def shuffled_buckets(docs: DataFrame, text: str = "text", seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Stored table (bucket, place, rec) of all records in random order, and the number of buckets."""
    total = docs.agg(F.sum(text_size(text))).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    rec = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")
    numbered = docs.select(F.monotonically_increasing_id().alias("number"), rec)
    scattered = numbered.select(
        F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(n_buckets)).cast("int").alias("bucket"), "number", "rec")
    # A fixed number of partitions and a fixed order inside them make the shuffle repeatable.
    gathered = (
        scattered.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("number", "rec")),
                          lambda a, b: F.when(a["number"] < b["number"], -1)
                          .when(a["number"] > b["number"], 1).otherwise(0)).alias("recs"))
        .sortWithinPartitions("bucket"))
    mixed = gathered.select("bucket", F.posexplode(F.shuffle("recs", seed)).alias("place", "r"))
    return materialize(mixed.select("bucket", "place", F.col("r.rec").alias("rec")), "buckets"), n_buckets


def shard(docs: DataFrame, n_shards: int, text: str = "text", seed: int = SEED,
          bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rec`` (all columns of the record) with its shard, 0 to ``n_shards`` - 1, and slot in it."""
    buckets, n_buckets = shuffled_buckets(docs, text, seed, bucket_bytes)
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(W.partitionBy()).alias("total"))
    if n_buckets <= MAX_BROADCAST_BUCKETS:  # one row a bucket
        offsets = F.broadcast(offsets)
    # The first total % n shards take one record more.
    base, more = F.expr(f"total div {n_shards}"), F.col("total") % n_shards
    long = more * (base + 1)
    at = F.col("before") + F.col("place")
    placed = buckets.join(offsets, "bucket").withColumn("at", at).withColumn("base", base)
    early = F.col("at") < long
    rest = F.col("at") - long
    return placed.select(
        "rec",
        F.when(early, F.expr("at div (base + 1)")).otherwise(
            more + F.floor(rest / F.greatest("base", F.lit(1)))).cast("int").alias("shard"),
        F.when(early, F.col("at") % (F.col("base") + 1)).otherwise(
            rest % F.greatest("base", F.lit(1))).cast("bigint").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each record with its slot below ``path``, one folder a shard."""
    sharded.select("rec.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard")).write.partitionBy(
        "_shard").parquet(path)
