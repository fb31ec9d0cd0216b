"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in its own pseudo-random order (an offset and a stride from its
name's hash); the shards take turns claiming their next free slot until the table is full, so each shard owns the same
number of slots to within one, and adding or removing a shard moves few others. The table's size depends only on the
number of shards, so it is broadcast; placing a row is one hash and one lookup. Native: no Python on the rows, and the
rows are never shuffled.

Defined results: a null key is placed as the empty string; equal keys always land on the same shard; an empty table
gives no rows. Extra columns pass through, whatever their names; columns named ``slot`` or ``shard`` are replaced, also where
one of them is the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots per shard, at least: the imbalance is under one slot in this many.
SLOTS_PER_SHARD = 100


def table_size(n_shards: int) -> int:
    """The smallest prime of at least ``SLOTS_PER_SHARD`` slots a shard."""
    size = max(2, SLOTS_PER_SHARD * n_shards)
    while any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        size += 1
    return size


def fill(shards: list[str], size: int | None = None) -> list[int]:
    """The table: for each slot the index of the shard that owns it."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct and at least one")
    size = size or table_size(len(shards))
    seeds = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in seeds]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in seeds]
    owner, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            owner[at[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def slot(key: Column, size: int) -> Column:
    """A key's slot: 60 bits of its MD5 modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup(spark: SparkSession, shards: list[str]) -> DataFrame:
    """(slot, shard): as many rows as the table has slots."""
    owner = ",".join(map(str, fill(shards)))
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("slot", "_owner")).select("slot", F.get(names, F.col("_owner").cast("int")).alias("shard"))


def assign(df: DataFrame, key: str, shards: list[str]) -> DataFrame:
    """``df`` plus each row's ``slot`` and ``shard``."""
    columns = [f"`{c}`" for c in df.columns if c not in ("slot", "shard")]
    rows = df.select(F.struct(*columns).alias("_row") if columns else F.struct(F.lit(0)).alias("_row"), slot(F.col(f"`{key}`"), table_size(len(shards))).alias("_slot"))
    placed = rows.join(F.broadcast(lookup(df.sparkSession, shards)), F.col("_slot") == F.col("slot"))
    return placed.select(*[F.col(f"_row.{c}") for c in columns], "slot", "shard")


def write(df: DataFrame, key: str, shards: list[str], path: str) -> None:
    """The rows as Parquet, one folder a shard."""
    assign(df, key, shards).write.partitionBy("shard").parquet(path)
