"""Weighted rendezvous hashing of record keys over shards.

Each (key, shard) pair has a hash u in (0, 1); a record goes to the shard with
the largest ``weight / -ln(u)``.  The choice needs the key and the shards' names
and weights alone.  A new shard only takes records for which it wins; no record
moves between old shards, and about ``weight / sum of weights`` of them move at
all.  Inside a shard records get gapless slots in the order of the key's hash.

Null keys share one hash (they go to one shard); null text counts as none.
Repeated keys go to the same shard, each row with a slot of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEX_RANGE, bucket_count, full_text, hex_number, running_total, staged


def _key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def shard_of(key: str, weights: list[float]) -> Column:
    """Shard number of a key: 0 to ``len(weights) - 1``, ties to the smallest number."""
    def score(i: int, weight: float) -> Column:
        u = (hex_number(F.md5(F.concat_ws(":", _key_text(key), F.lit(str(i))))) + F.lit(0.5)) / F.lit(float(HEX_RANGE))
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-i).alias("shard"))
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if len(weights) == 1:
        return F.lit(0)
    return (-F.greatest(*[score(i, w) for i, w in enumerate(weights)])["shard"]).cast("int")


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes plus 1), text_crc32, shard, grown_shard (by ``grown`` weights, null if none)."""
    whole = full_text(text)
    return docs.select(F.col(key), (F.octet_length(whole) + 1).cast("long").alias("size"),
                       F.crc32(whole).cast("long").alias("text_crc32"), shard_of(key, weights).alias("shard"),
                       (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))


def with_slots(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds slot: 0, 1, ... inside each shard by hash of the key (ties: key, crc32, size)."""
    fixed = staged(assigned.withColumn("__place", hex_number(F.md5(_key_text(key)))).withColumn("__one", F.lit(1)), "shards")
    return running_total(fixed, "shard", "__place", [key, "text_crc32", "size"], "__one", "slot",
                         bucket_count(fixed.count())).drop("__place", "__one")


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """Writes all columns of ``docs`` as Parquet, one folder ``shard=N`` per shard.

    Rows are dealt to tasks by (shard, key hash), so a shard is written by many tasks.
    """
    spread = F.pmod(F.xxhash64(key), F.lit(bucket_count(docs.count())))
    docs.withColumn("shard", shard_of(key, weights)).repartition("shard", spread).write.partitionBy("shard").parquet(path)
