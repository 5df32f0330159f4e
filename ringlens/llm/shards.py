"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash draw u in (0, 1); a record goes to the
shard with the largest ``weight / -ln(u)``. The draw of a pair depends on
nothing else, so adding a shard moves only the records that the new shard wins,
and each shard gets a share in proportion to its weight.

Defined cases: a null key counts as the empty key (all null keys share one
shard); a null text has no bytes and the checksum 0; repeated rows go to one
shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ringlens.llm.common import Scratch

N_SHARDS = 16
#: Numbering groups of a shard: slots are numbered inside (shard, bucket) and shifted by the counts before.
SLOT_BUCKETS = 256


def rendezvous(key: Column, n_shards: int, weights: list[float] | None = None) -> Column:
    """Shard in 0..n_shards-1 of a key; ``weights`` defaults to equal shares."""
    weights = weights or [1.0] * n_shards
    if len(weights) != n_shards or min(weights) <= 0:
        raise ValueError("one positive weight a shard")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(s: int) -> Column:
        # 52 bits of the pair's hash, moved off 0 and 1
        draw = (F.shiftrightunsigned(F.xxhash64(text, F.lit(s)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.struct((F.lit(float(weights[s])) / -F.log(draw)).alias("score"), F.lit(-s).alias("minus"))

    return (-F.array_max(F.array(*[score(s) for s in range(n_shards)]))["minus"]).cast("int")


def shard_documents(df: DataFrame, n_shards: int = N_SHARDS, weights: list[float] | None = None,
                    grown_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``slot`` is gapless from 0 inside a shard. It is numbered in (shard, bucket)
    groups, whose counts (shards x buckets numbers) are summed up first, so no
    task holds a whole shard.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    weights = weights or [1.0] * n_shards
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = scratch.table(df.select(
        F.col(key).alias("doc_id"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        rendezvous(F.col(key), n_shards, weights).alias("shard"),
        rendezvous(F.col(key), n_shards + 1, [*weights, grown_weight]).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLOT_BUCKETS)).cast("int")))
    counts = slim.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = slim.withColumn("rank", F.row_number().over(inside) - 1)
    # at most shards x buckets rows, so the broadcast has a bound that does not grow with the data
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("rank")).cast(T.LongType()).alias("slot"), "grown_shard")
