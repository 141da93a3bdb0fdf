"""Placement by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, (offset + i * skip) mod size. Shards take
turns claiming the next free slot they prefer, so each gets size / shards slots, give or take one, and few slots change
hands when a shard comes or goes. A row's slot is a hash of its key; the table is broadcast (its size is
the parameter) and one look-up places a row. No shuffle, no Python on the rows.

Rows without a key are placed by a hash of all their columns, so that they don't share a shard. Equal keys share one. Every row
gives a row with all its columns; existing columns named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of slots."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the place of its shard in ``shards``. The order of ``shards`` doesn't matter to who owns a slot."""
    if not is_prime(size):
        raise ValueError("the table size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    order = sorted(range(len(shards)), key=shards.__getitem__)
    nexts = {s: preference(shards[s], size) for s in order}
    table, left = [-1] * size, size
    while left:
        for s in order:
            slot, skip = nexts[s]
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot] = s
            nexts[s] = ((slot + skip) % size, skip)
            left -= 1
            if not left:
                break
    return table


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) with ``size`` rows."""
    owners = F.lit(",".join(map(str, fill(shards, size))))
    names = F.lit("\n".join(shards))
    slots = spark.range(1).select(F.posexplode(F.split(owners, ",")).alias("slot", "owner"))
    return slots.select("slot", F.split(names, "\n")[F.col("owner").cast("int")].alias("shard"))


def place(rows: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with their ``slot`` and ``shard``."""
    rows = rows.drop("slot", "shard")
    value = F.coalesce(F.xxhash64(F.when(F.col(key).isNotNull(), F.col(key))), F.lit(0).cast("long"))
    value = F.when(F.col(key).isNotNull(), value).otherwise(F.xxhash64(*rows.columns))
    slotted = rows.withColumn("slot", F.pmod(value, F.lit(size)).cast("int"))
    return slotted.join(F.broadcast(lookup_table(rows.sparkSession, shards, size)), "slot").select(*rows.columns, "slot", "shard")
