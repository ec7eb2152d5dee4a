"""Placement of rows on shards by a lookup table that the shards fill in turns.

Every shard has its own order of preference over the slots of a prime-sized table (an offset and a step drawn from
its name).  Taking turns, each shard claims the first slot of its order that is still free, so shards get equal
shares (within one slot, or in proportion to their weights) and most slots keep their shard when one comes or goes.
A row's slot is a hash of its key; the table is joined by broadcast, its size is the prime, not the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
# The table is broadcast; at some 30 bytes a slot this many stay below 32 MB.
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _draw(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.md5(f"{purpose}:{name}".encode()).digest()[:8], "big")


def preference(name: str, slots: int) -> np.ndarray:
    """The order in which a shard wants the slots: offset + k * step modulo the prime."""
    offset, step = _draw(name, "offset") % slots, _draw(name, "step") % (slots - 1) + 1
    return (offset + np.arange(slots, dtype=np.int64) * step) % slots


def fill_table(shards: Sequence[str] | Mapping[str, float], slots: int = SLOTS) -> list[str]:
    """The shard of every slot.

    ``shards`` are names, or names with positive weights.  In each round every shard's credit grows by its weight
    over the largest weight; whole credits are turns.  The result does not depend on the order given.
    """
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1.0)
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need names and positive weights")
    if not _is_prime(slots) or not len(weights) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime of {len(weights)} to {MOST_SLOTS}, not {slots}")
    names = sorted(weights)
    largest = max(weights.values())
    draws = [(_draw(n, "offset") % slots, _draw(n, "step") % (slots - 1) + 1) for n in names]
    place, credit = [0] * len(names), [0.0] * len(names)
    owner: list[str | None] = [None] * slots
    free = slots
    while free:
        for i, name in enumerate(names):
            credit[i] += weights[name] / largest
            if credit[i] < 1 or not free:
                continue
            credit[i] -= 1
            offset, step = draws[i]
            while owner[slot := (offset + place[i] * step) % slots] is not None:
                place[i] += 1
            owner[slot] = name
            place[i] += 1
            free -= 1
    return owner


def slot_of(key: Column, slots: int, part: Column | None = None) -> Column:
    """Slot of a key; ``part`` tells the parts of a split key apart (part 0 is where the whole key would go)."""
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    if part is not None:
        text = F.when(part == 0, text).otherwise(F.concat_ws("\0", text, part.cast("string")))
    return F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")


def place(
    df: DataFrame,
    key: str,
    shards: Sequence[str] | Mapping[str, float],
    *,
    spread_by: str | None = None,
    slots: int = SLOTS,
    slot_column: str = "slot",
    shard_column: str = "shard",
) -> DataFrame:
    """All rows with their slot and shard; columns of these names in the input are replaced.

    Rows of equal key meet on one shard, nulls too.  With ``spread_by`` a key with more than a shard's fair share of
    all rows is split into as many parts as it fills shards, by a hash of that column: such keys are at most as many
    as shards, so their list is small enough to broadcast.  An empty table stays empty; repeated rows go together.
    """
    spark: SparkSession = df.sparkSession
    owners = fill_table(shards, slots)
    df = df.drop(slot_column, shard_column)
    part = None
    if spread_by is not None:
        n = len(shards)
        total = df.count()
        counts = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"))
        hot = counts.where(F.col("__rows") * n > total)
        hot = F.broadcast(hot.select("__key", F.ceil(F.col("__rows") * n / total).cast("int").alias("__parts")))
        df = df.join(hot, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
        part = F.pmod(F.xxhash64(F.col(spread_by)), F.coalesce("__parts", F.lit(1)))
    placed = df.withColumn(slot_column, slot_of(F.col(key), slots, part)).drop("__parts")
    table = spark.createDataFrame(list(enumerate(owners)), f"`{slot_column}` int, `{shard_column}` string")
    return placed.join(F.broadcast(table), slot_column)
