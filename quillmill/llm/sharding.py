"""Sharding by fixed virtual slots (operator 3); DataFrame functions only.

Records are hashed into ``SLOTS`` virtual slots, bytes are summed per slot, and a versioned
slot-to-shard map says where each slot lives. Rebalancing edits the map, not the hash: a new
version moves whole slots, and only from the fullest shards. The first version deals slots in
turn; the second is its rebalancing by the bytes that were counted.

The law is ``bytes``: shards get nearly equal sizes. The map has ``SLOTS`` rows whatever the
input is; they alone reach the driver and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def moved(self, shard_of: list[int], shards: int) -> SlotMap:
        return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(shard_of))


def even_slots(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1, before any record is known: slots in turn."""
    return SlotMap(1, shards, tuple(k % shards for k in range(slots)))


def rebalance(current: SlotMap, sizes: list[int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
    """The next version: slots go from the fullest to the emptiest shard until none is over the mean by ``slack``.

    Where no slot is small enough to go, two are exchanged. With more shards than before, the new
    ones start empty, so that they mostly take and few slots move otherwise. Fewer shards give
    up all slots of the removed ones.
    """
    shards = shards or current.shards
    weight = np.array(sizes, np.int64)
    shard_of = np.array(current.shard_of)
    loads = np.bincount(shard_of[shard_of < shards], weight[shard_of < shards], minlength=shards).astype(np.int64)
    homeless = np.flatnonzero(shard_of >= shards)
    for slot in homeless[np.argsort(-weight[homeless], kind="stable")]:
        shard_of[slot] = loads.argmin()
        loads[shard_of[slot]] += weight[slot]
    for _ in range(4 * len(sizes)):
        full, empty = int(loads.argmax()), int(loads.argmin())
        gap = loads[full] - loads[empty]
        if loads[full] <= loads.mean() * (1 + slack):
            break
        ours, theirs = np.flatnonzero(shard_of == full), np.flatnonzero(shard_of == empty)
        step = weight[ours][:, None]
        exchange = not ((step > 0) & (step < gap)).any()
        if exchange:
            step = step - weight[theirs][None]
        fits = np.where((step > 0) & (step < gap), np.abs(2 * step - gap), np.iinfo(np.int64).max)
        if not fits.size or fits.min() == np.iinfo(np.int64).max:
            break
        i, j = np.unravel_index(fits.argmin(), fits.shape)
        shard_of[ours[i]] = empty
        if exchange:
            shard_of[theirs[j]] = full
        loads[full] -= step[i, j]
        loads[empty] += step[i, j]
    return current.moved(shard_of.tolist(), shards)


def slot_of(*record: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record. What is hashed should tell records apart, or they share a slot."""
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


def slot_totals(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot of (slot, size) records; ``slots`` rows reach the driver."""
    sizes, rows = [0] * slots, [0] * slots
    for r in records.groupBy("slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        sizes[r.slot], rows[r.slot] = r["size"], r.n
    return sizes, rows


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add this version to the map table at ``path``."""
    rows = [(slot_map.version, slot_map.shards, k, s) for k, s in enumerate(slot_map.shard_of)]
    spark.createDataFrame(rows, "version int, shards int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map, by default the latest."""
    table = spark.read.parquet(path)
    version = version or table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def place(records: DataFrame, slot_map: SlotMap, rows_of: list[int], order: list[str]) -> DataFrame:
    """``records`` with shard and position, the row's place in its shard, gapless from 0.

    Slots of a shard lie one after the other; within a slot rows go by ``order``, then size. So
    no task sorts more than a slot, and no shard is ever sorted whole.
    """
    starts, filled = [0] * len(rows_of), [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        starts[slot] = filled[shard]
        filled[shard] += rows_of[slot]
    rows = [(k, s, starts[k]) for k, s in enumerate(slot_map.shard_of)]
    table = records.sparkSession.createDataFrame(rows, "slot int, shard int, start long")
    within = F.row_number().over(Window.partitionBy("slot").orderBy(*order)) - 1
    return records.withColumn("within", within).join(F.broadcast(table), "slot").withColumn("position", F.col("start") + F.col("within")).drop("start", "within")
