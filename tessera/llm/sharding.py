"""Sharding: a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, given by an offset and a step derived
from its name. The shards take turns; at its turn a shard claims the first slot of its order that is still free,
until the table is full. Shares differ by one slot at most, and when a shard goes, few keys of the others move.
The table has a fixed number of slots whatever the data, so it is broadcast, and placement is one hash and one
lookup; a key is hashed row by row, so a hot source or host is spread like any other rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: slots of the table; a prime, at least 100 times the number of shards
SLOTS = 65537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot. Names must be distinct, and at least one."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if len(shards) > slots or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    place = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            at = place[i]
            while owner[at] >= 0:
                at = (at + step[i]) % slots
            owner[at] = i
            place[i] = (at + step[i]) % slots
            left -= 1
            if not left:
                break
    return np.array(owner, np.int32)


def slot_of(key, slots: int = SLOTS):
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def assign_shards(spark: SparkSession, df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard` by the key column; columns of these names are replaced.

    A null key is placed as an empty one; repeated keys land together; an empty table stays empty.
    """
    owner = lookup_table(shards, slots)
    table = pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": np.array(shards, object)[owner]})
    table = spark.createDataFrame(table, "slot int, shard string")
    df = df.drop("shard").withColumn("slot", slot_of(F.col(key), slots))
    return df.join(F.broadcast(table), "slot").select(*df.columns, "shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of every document on 64 shards."""
    shards = [f"shard-{i:03d}" for i in range(64)]
    return assign_shards(spark, documents(spark, sf_dir).select("doc_id"), shards)
