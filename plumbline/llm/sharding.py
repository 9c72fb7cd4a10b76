"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (a start and a stride from
hashes of its name). The shards take turns, each claiming the first slot of its order that is still free, until
the table is full; so shares differ by one slot at most, and adding a shard moves few slots. A row is placed by
the slot that its key hashes to. The table's size is a parameter and at most MAX_SLOTS, so it can always be broadcast.

Cases: rows with the same key share a shard; a null key counts as an empty one; keys may be of any type; a very long text is not
looked at; an empty table gives an empty table; other columns are kept, whatever their names, but for one named out_col, which is
replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fields, whole_row

MAX_SLOTS = 1_000_003


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards or not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards (1 at least) to {MAX_SLOTS}")
    start = [_hash(f"start:{s}") % slots for s in shards]
    stride = [_hash(f"stride:{s}") % (slots - 1) + 1 for s in shards]
    turn = [0] * len(shards)
    table = [-1] * slots
    free = slots
    while True:
        for k in range(len(shards)):
            while table[at := (start[k] + turn[k] * stride[k]) % slots] >= 0:
                turn[k] += 1
            table[at] = k
            turn[k] += 1
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int) -> Column:
    hashed = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    return F.pmod(hashed, F.lit(slots).cast("long"))


def assign_shards(df: DataFrame, n_shards: int = 32, slots: int = 4099, key_col: str = "doc_id", out_col: str = "shard") -> DataFrame:
    """df with the number of each row's shard."""
    table = lookup_table([f"shard-{k}" for k in range(n_shards)], slots)
    text = F.lit(",".join(map(str, table)))
    placed = df.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(text, ",")).alias("shard_slot", "shard_no"))
    placed = placed.select(F.col("shard_slot").cast("long"), F.col("shard_no").cast("long"))
    rest = [c for c in df.columns if c != out_col]
    keyed = df.select(whole_row(df).alias("row"), slot_of(col(key_col), slots).alias("key_slot"))
    return keyed.join(F.broadcast(placed), F.col("key_slot") == F.col("shard_slot"), "left").select(*fields("row", rest), F.col("shard_no").alias(out_col))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """One folder of Parquet files a shard; a shard's rows are split over many tasks."""
    placed = assign_shards(df, **options)
    placed.write.partitionBy(options.get("out_col", "shard")).parquet(path)
