"""Placement by a permutation-filled lookup table.

Every shard visits the slots of a prime-sized table in its own order (offset and step from a hash
of its name). Shards take turns; each turn claims the first free slot of the shard's order. A key
goes to the shard at slot hash(key) mod size. Adding or removing a shard moves little else.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """Slot to shard number. ``slots`` must be prime and larger than the number of turns in a round.

    A shard of weight w takes w turns a round. Names must differ; no shards is an error.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named and differ")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    turns = [i for i, w in enumerate(weights or [1] * len(shards)) for _ in range(w)]
    if not turns or len(turns) > slots:
        raise ValueError("a round must have a turn, and no more turns than slots")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    table = [-1] * slots
    free = slots
    while free:
        for shard in turns:
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                break
    return np.array(table, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the md5 of the key as text, modulo the table's size."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, shards: list[str], key: str = "doc_id", text: str | None = "text", slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (a name of ``shards``) added, or replaced where they exist.

    The table has one row per slot, a bound set by ``slots``, and is broadcast; rows are not moved.
    A null key is placed by the text, so rows without a key are spread; without text by the empty
    text. Repeated keys meet in one shard. An empty table stays empty.
    """
    table = lookup_table(shards, slots, weights)
    numbers = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot long, shard string")
    fallback = [F.md5(F.col(text).cast("binary"))] if text and text in df.columns else []
    key_text = F.coalesce(F.col(key).cast("string"), *fallback, F.lit(""))
    return df.drop("slot", "shard").withColumn("slot", slot_of(key_text, slots)).join(F.broadcast(numbers), "slot", "left")
