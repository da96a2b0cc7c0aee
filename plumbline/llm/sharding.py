"""Placement of rows on shards by a permutation-filled lookup table.

Shards take turns claiming slots of a prime-sized table, each in its own preference order, until the table is
full. A row's key hashes to a slot; a broadcast of the table gives its shard in constant time. When a shard
joins or leaves, only about its own share of the slots changes hands.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare

#: A prime: every step from 1 to SLOTS - 1 then visits all slots.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard that owns each slot. Shares differ by one slot at most."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need one name each")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots has to be a prime, and no less than the number of shards")
    at = np.array([xxhash.xxh3_64_intdigest(s, 1) % slots for s in shards])
    step = np.array([xxhash.xxh3_64_intdigest(s, 2) % (slots - 1) + 1 for s in shards])
    table = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def place(docs: DataFrame, shards: list[str] | int = 64, key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """docs with slot (int) and shard (string) for each row; columns of these names are replaced.

    Rows of equal keys share a slot; null keys are a key of their own. Keys are hashed as text, so that 7 and
    "7" meet. The broadcast table has exactly `slots` rows (about 1 MB), whatever the size of docs; nothing
    shuffles, so skewed or repeated keys cost nothing. An empty table stays empty.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    table = fill_table(names, slots)
    spark = docs.sparkSession
    at, name, owner = spare(docs, "_at"), spare(docs, "slot"), spare(docs, "shard")
    lookup = spark.createDataFrame([(i, names[s]) for i, s in enumerate(table.tolist())], f"{name} int, {owner} string")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("\x00null"))), F.lit(slots)).cast("int")
    met = docs.withColumn(at, slot).join(F.broadcast(lookup), F.col(at) == F.col(name), "left")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    return met.select(*rest, F.col(at).alias("slot"), F.col(owner).alias("shard"))
