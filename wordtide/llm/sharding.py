"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size (an offset and a
stride, both from its name). Shards take turns; at its turn a shard claims the first slot of its
order that is still free. The filled table is broadcast, so placing a row is one hash and one
lookup. Shards hold slot counts that differ by one at most, and when a shard leaves, few rows move
besides its own.

Main path: DataFrame functions only. The table has ``table_size`` entries, whatever the data.

Defined results: a null key is placed like the text ``\\u0000null``; equal keys share a shard; an
empty table gives no rows; extra columns pass through, and columns named like the two that are
added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import packed

#: The largest table that is broadcast (entries of a few bytes each).
MAX_TABLE_SIZE = 1_000_003
NULL_KEY = "\x00null"


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def preference(name: str, table_size: int) -> tuple[int, int]:
    """Offset and stride; the stride is coprime to the prime size, so the order visits every slot once."""
    return _hash(name, "offset") % table_size, _hash(name, "stride") % (table_size - 1) + 1


def fill_table(shards: Sequence[str], table_size: int) -> list[int]:
    """The owner (index into ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not is_prime(table_size) or not len(shards) <= table_size <= MAX_TABLE_SIZE:
        raise ValueError("table_size must be a prime from the number of shards up to MAX_TABLE_SIZE")
    table, taken = [-1] * table_size, 0
    position, stride = map(list, zip(*(preference(s, table_size) for s in shards), strict=True))
    while True:
        for shard in range(len(shards)):
            while table[position[shard]] >= 0:
                position[shard] = (position[shard] + stride[shard]) % table_size
            table[position[shard]] = shard
            taken += 1
            if taken == table_size:
                return table


def slot_of(key: Column, table_size: int) -> Column:
    """60 bits of the key's MD5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(table_size)).cast("int")


def place(docs: DataFrame, key: str, shards: Sequence[str], table_size: int = 10_007, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``docs`` with the slot and the shard index of every row."""
    owners = ",".join(map(str, fill_table(shards, table_size)))
    lookup = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("of_slot", "owner"))
    safe, restore = packed(docs, key)
    keyed = safe.withColumn("its_slot", slot_of(F.col(key), table_size))
    placed = keyed.join(F.broadcast(lookup), keyed["its_slot"] == lookup["of_slot"], "left")
    return restore(placed.withColumns({slot_col: F.col("its_slot"), shard_col: F.col("owner").cast("int")}), slot_col, shard_col)


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard", files_per_shard: int = 8) -> None:
    """One folder per shard. Rows of a shard are spread over ``files_per_shard`` tasks by a hash of the whole row."""
    spread = F.pmod(F.xxhash64(*[c for c, t in placed.dtypes if not t.startswith("map")]), F.lit(files_per_shard))
    part = "part" + "_" * max(map(len, placed.columns))  # longer than any name there is
    placed.withColumn(part, spread).repartition(shard_col, part).drop(part).write.partitionBy(shard_col).parquet(path)
