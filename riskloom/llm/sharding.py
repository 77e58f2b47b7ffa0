"""Weighted rendezvous sharding of stable record keys.

Every shard bids for a key: minus its weight over the logarithm of a uniform number drawn from
md5(key, shard). The highest bid gets the record, so a shard's share follows its weight and a new
shard takes records only into itself. A record's slot is its gapless number in its shard: records
are ordered by a bucket (three hex digits of a hash of the key), then by key, checksum and size.
Only one (shard, bucket) is ordered at a time; the counts of the buckets before are added from a
table of shards x 4096 rows at most, which is broadcast.

A null key counts as the empty string, a null text as empty. Repeated rows share a shard and get
consecutive slots. An empty table gives an empty one. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3  # 16**3 buckets a shard


def uniform(key: Column, salt: str) -> Column:
    """60 bits of md5(key:salt) as a number."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, 15), 16, 10).cast("long")


def owner(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, that wins the key."""
    bids = [
        F.struct((F.lit(-w) / F.log((uniform(key, str(s)) + 0.5) / float(1 << 60))).alias("bid"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    return F.array_max(F.array(*bids))["shard"]


def sharded(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (with the weights `grown`) of every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        owner(key, weights).alias("shard"),
        (owner(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.substring(F.md5(F.concat(key, F.lit(":slot"))), 1, BUCKET_DIGITS).alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = counts.select("shard", "bucket", before.alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(own)).join(F.broadcast(starts), ["shard", "bucket"])
    slot = (F.col("before") + F.col("nth") - 1).cast("long")
    return numbered.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "grown_shard")
