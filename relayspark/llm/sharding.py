"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size (an offset and a stride
from a digest of its name). The shards take turns, each claiming the first slot of its order that is free,
until all slots are taken; a shard of weight w takes w turns a round. Keys hash to a slot, and the table,
of fixed size whatever the data, gives the shard. When a shard leaves, few keys of the others move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime number of slots, much larger than the number of shards.
SLOTS = 65_537
SHARDS = 64


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and stride of a shard's walk over the slots; the stride is never 0, so it visits them all."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The index of the owning shard for each slot."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights must not be negative, and one must be positive")
    walks = [preference(s, slots) for s in shards]
    at, owner, free = [offset for offset, _ in walks], [-1] * slots, slots
    while free:
        for i, (_, stride) in enumerate(walks):
            for _ in range(turns[i]):
                if not free:
                    break
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + stride) % slots
                owner[at[i]] = i
                free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text. A null key has slot 0."""
    bits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return F.coalesce(F.pmod(bits, F.lit(slots)), F.lit(0)).cast("long")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """The lookup table as rows (slot, shard); ``slots`` rows, so it is safe to broadcast."""
    owners = ",".join(map(str, lookup_table(shards, slots, weights)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.col("owner").cast("long").alias("shard"))


def assign(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (an index into ``shards``) by a broadcast of the table; no shuffle.

    Rows with a null key go to the owner of slot 0. Equal keys go to the same shard. Columns of ``df`` that
    are named ``slot`` or ``shard`` are replaced, also where one of them is the key. An empty table stays empty.
    """
    table = F.broadcast(table_frame(df.sparkSession, shards, slots, weights))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return df.select(*kept, slot_of(F.col(f"`{key}`"), slots).alias("slot")).join(table, "slot")


def write_shards(df: DataFrame, path: str, key: str, shards: list[str]) -> None:
    """Write ``df`` with a folder for each shard; null keys and repeated rows as ``assign`` has them, no folder for an
    empty shard. Rows meet by shard, and Spark splits a shard that is much larger than others between tasks by where
    its rows come from, so neither a hot key nor a hot row ends up in one."""
    assign(df, key, shards).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
