"""Sharding by jump consistent hashing, in DataFrame functions alone.

A key walks from shard 0 through ever higher shards by pseudo-random jumps and stays in the last one below the shard
count; so with one shard more a key either stays or goes to the new shard. The walk's draws are xxhash64 of the key and
the step in place of a 64-bit linear generator, whose overflow ANSI SQL forbids; the walk and its law are the same.

Slots are counted without bringing a shard together: equal rows are counted first, a shard's rows are dealt into
buckets of about BUCKET rows by hash, and a bucket's first slot is the sum of the buckets before it.

Null text: size 8, crc32 of no bytes (0). A null doc_id is a key like any other. Repeated rows lie in the same shard at
neighbouring slots. Equal texts with different doc_ids are different keys. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusql.llm.common import cut, table

SHARDS, BUCKET = 24, 50_000


def jump_shard(key: str, shards: int) -> Column:
    """The shard of column ``key`` among ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard")
    draw = f"(shiftrightunsigned(xxhash64(`{key}`, i), 33) + 1) / 2147483648D"
    return F.expr(
        f"cast(aggregate(sequence(1, {shards}), named_struct('b', -1L, 'j', 0L), "
        f"(a, i) -> if(a.j < {shards}, named_struct('b', a.j, 'j', cast(floor((a.j + 1) / ({draw})) as bigint)), a), a -> a.b) as int)"
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (with one shard more) of each row of ``docs``."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    buckets = max(1, -(-docs.count() // (bucket * shards)))
    rows = rows.withColumns({
        "shard": jump_shard("doc_id", shards),
        "grown_shard": jump_shard("doc_id", shards + 1),
        "bucket": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)),
    })
    rows = cut(rows)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("held")).select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(firsts, ["shard", "bucket"]).withColumn("at", F.col("first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    slots = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", slots, "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """``docs`` as Parquet, a folder for each shard."""
    docs.withColumn("shard", jump_shard("doc_id", shards)).write.partitionBy("shard").parquet(path)


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
