"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table: a start and a step derived from its name.
Shards take turns claiming their most preferred free slot until the table is full, so shards own equal numbers of slots (give or
take one) and adding or removing a shard moves little else. A row's slot is a hash of its key modulo the table's size; the table
is broadcast (its size is fixed), so placement is one lookup and shuffles nothing.

Defined cases: a null key is placed by the key "" ; equal keys always share a shard; an empty table gives an empty result; a column
that is already named like a result column is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:12], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the owning shard by slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most one a slot")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, so that every step visits every slot")
    names = sorted(shards)
    place = {name: i for i, name in enumerate(shards)}
    at = [_number(f"start/{s}") % slots for s in names]
    step = [_number(f"step/{s}") % (slots - 1) + 1 for s in names]
    table = np.full(slots, -1, np.int32)
    filled = 0
    while filled < slots:
        for k, name in enumerate(names):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = place[name]
            filled += 1
            if filled == slots:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The rows with their ``slot`` and ``shard``."""
    if clash := {"slot", "shard"} & set(df.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    spark = df.sparkSession
    table = fill(shards, slots)
    lookup = spark.createDataFrame(list(enumerate([shards[i] for i in table])), "slot long, shard string")
    return df.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(lookup), "slot").select(*df.columns, "slot", "shard")  # slots rows
