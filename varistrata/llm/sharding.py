"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varistrata.llm.common import cut_lineage, table

SHARDS = 24
SEED = 20_011


def _score(key: Column, shard: int, weight: float, seed: int) -> Column:
    """-weight / ln(u) with u in (0, 1) from 52 bits of the hash of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 12)
    return F.lit(float(weight)) / -F.log((bits.cast("double") + 0.5) / float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard with the largest score; equal scores go to the larger shard number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_max(F.array(*[F.struct(_score(key, i, w, seed).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]))["i"]


def with_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown: float | None = 1.0, seed: int = SEED) -> DataFrame:
    """Rows of docs with `shard` and, for one more shard of weight `grown`, `grown_shard`; columns of those names are replaced.

    Only the key and the shard list decide, so a further shard takes rows only into itself. A null
    key of any type is replaced by the hash of the text; null texts with null keys share a shard. Equal keys share a shard.
    """
    own = F.col(key) if dict(docs.dtypes)[key] == "bigint" else F.xxhash64(F.col(key))
    stable = F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(own)
    out = docs.withColumn("shard", rendezvous(stable, weights, seed))
    return out if grown is None else out.withColumn("grown_shard", rendezvous(stable, [*weights, grown], seed))


def with_slots(placed: DataFrame) -> DataFrame:
    """Gapless numbers from 0 in each shard.

    The rows are checkpointed, so the parts that are counted and numbered are the same. A shard is numbered
    part by part: each window holds rows of one part and shard only, however large a shard or key is.
    """
    fixed = cut_lineage(placed).withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = fixed.groupBy("shard", "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32")
    numbered = fixed.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "_part"]).withColumn("slot", (F.col("_start") + F.col("_row")).cast("long")).drop("_start", "_row", "_part")


def plan(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row, repeated rows included.

    Null text: size 8, checksum of no bytes (0). An empty table gives no rows. Only the key, size and checksum are shuffled.
    """
    sized = docs.select(
        F.col(key).alias("doc_id"),
        F.col(text).alias("text"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = with_shards(sized, weights or [1.0] * shards, "doc_id", "text").drop("text")
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))
