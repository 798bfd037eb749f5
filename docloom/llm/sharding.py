"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard prefers the slots of a prime-sized table in an order of its own (offset + i * skip); the shards take turns
claiming their next free slot, heavier ones more turns. A key's hash picks a slot, and a broadcast of the table gives
its shard: no shuffle, constant time, and few keys move when a shard comes or goes. The table has ``slots`` rows, at
most MAX_SLOTS, whatever the data.

A null key is placed as the text "" with a marker of its own; equal keys get the same shard; other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import column, fresh

MAX_SLOTS = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = 65_537, weights: Sequence[int] | None = None) -> list[int]:
    """For each slot the index of its shard. slots: a prime above the number of shards."""
    if not shards or len(set(shards)) < len(shards) or not _prime(slots) or not len(shards) < slots <= MAX_SLOTS:
        raise ValueError(f"distinct shards, fewer than a prime number of slots up to {MAX_SLOTS}, are needed")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("weights: a whole number for each shard, not all 0")
    seeds = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(h[:8], "big") % slots for h in seeds]
    skip = [int.from_bytes(h[8:16], "big") % (slots - 1) + 1 for h in seeds]
    table, free = [-1] * slots, slots
    while free:
        for i, n in enumerate(turns):
            for _ in range(n):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                free -= 1
                if not free:
                    return table
    return table


def slot_of(key: Column, slots: int) -> Column:
    """48 bits of the key's md5, modulo the number of slots."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.lit(slots)


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard) of a lookup table."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "s")).select(F.col("slot").cast("long").alias("slot"), F.col("s").cast("int").alias("shard"))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], slots: int = 65_537, weights: Sequence[int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the shard index of each row; columns of df with these two names are replaced."""
    own, at, to = (fresh(n, df.columns) for n in ("docloom key slot", "docloom slot", "docloom shard"))
    t = table_frame(df.sparkSession, lookup_table(shards, slots, weights)).select(F.col("slot").alias(at), F.col("shard").alias(to))
    d = df.withColumn(own, slot_of(column(key), slots))
    d = d.join(F.broadcast(t), d[own] == t[at])
    others = [column(c) for c in df.columns if c not in (slot_col, shard_col)]
    return d.select(*others, F.col(at).alias(slot_col), F.col(to).alias(shard_col))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder for each shard; a large shard gets as many files as tasks hold rows of it."""
    df.write.partitionBy(shard_col).parquet(path)
