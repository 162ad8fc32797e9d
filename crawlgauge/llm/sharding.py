"""Sharding over fixed virtual slots.

Each record is hashed into one of a few thousand virtual slots. Bytes and rows are summed per slot,
and a versioned table says which shard each slot lives in. Records never change slots: rebalancing
edits the table, and only the records of edited slots move.

Defined cases: a null text counts as the empty text, a null id is hashed by its text instead, equal
rows share a slot and get neighbouring positions, an empty table gives a map of empty slots, and
further columns of the input are carried through unless they bear a name this operator writes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlgauge.llm.common import scratch_path

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, n_bytes long, n_rows long"

SlotStats = dict[int, tuple[int, int]]  # slot -> (bytes, rows)
SlotMap = dict[int, int]  # slot -> shard


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text and one for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def with_slots(docs: DataFrame, n_slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add size and virtual_slot; the slot depends on the key alone."""
    code = F.when(F.col(key).isNull(), F.xxhash64(F.lit(1), F.col(text))).otherwise(F.xxhash64(key))
    return docs.withColumns(
        {"size": record_size(F.col(text)), "virtual_slot": F.pmod(code, F.lit(n_slots)).cast("int")}
    )


def slot_stats(slotted: DataFrame) -> SlotStats:
    """Bytes and rows per slot: summed map-side, at most as many rows as there are slots."""
    sums = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return {r.virtual_slot: (r.b, r.n) for r in sums.collect()}


def initial_map(stats: SlotStats, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
    """Largest slots first, each to the shard with the fewest bytes so far; empty slots by number."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed: SlotMap = {}
    for slot in sorted(range(n_slots), key=lambda s: (-stats.get(s, (0, 0))[0], s)):
        load, shard = heapq.heappop(heap)
        placed[slot] = shard
        # An empty slot counts as one byte, so that empty slots are dealt evenly too.
        heapq.heappush(heap, (load + max(1, stats.get(slot, (0, 0))[0]), shard))
    return placed


def rebalance(current: SlotMap, stats: SlotStats, n_shards: int, slack: float = 0.02) -> SlotMap:
    """Edit a map for another number of shards or other sizes, moving slots only where they help.

    Slots of removed shards move; then the fullest shard gives the emptiest one a slot for as long
    as the two differ by more than ``slack`` of the mean load and the larger of them shrinks.
    """
    size = {slot: stats.get(slot, (0, 0))[0] for slot in current}
    shards: dict[int, list[int]] = {shard: [] for shard in range(n_shards)}
    load = dict.fromkeys(shards, 0)
    homeless = []
    for slot, shard in current.items():
        if shard in shards:
            shards[shard].append(slot)
            load[shard] += size[slot]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-size[s], s)):
        shard = min(load, key=lambda k: (load[k], k))
        shards[shard].append(slot)
        load[shard] += size[slot]
    while True:
        full, empty = max(load, key=lambda k: (load[k], -k)), min(load, key=lambda k: (load[k], k))
        gap = load[full] - load[empty]
        fitting = [s for s in shards[full] if 0 < size[s] < gap]
        if not fitting or gap <= slack * sum(load.values()) / n_shards:
            break
        slot = min(fitting, key=lambda s: (abs(gap - 2 * size[s]), s))
        shards[full].remove(slot)
        shards[empty].append(slot)
        load[full] -= size[slot]
        load[empty] += size[slot]
    return {slot: shard for shard, slots in shards.items() for slot in slots}


def write_map(spark: SparkSession, path: str, version: int, slot_map: SlotMap, stats: SlotStats) -> None:
    """Store one version of the map; earlier versions stay."""
    rows = [(version, s, shard, *stats.get(s, (0, 0))) for s, shard in sorted(slot_map.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/map_version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/map_version={version}")


def place(slotted: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Add shard, slot (position in the shard, gapless from 0) and map_version.

    A position is the number of records in earlier virtual slots of the shard plus the position in
    the own virtual slot, so no task sees more than one virtual slot at a time.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    known = slot_map.select(
        "virtual_slot",
        "shard",
        F.col("version").alias("map_version"),
        F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("_first"),
    )
    inside = Window.partitionBy("virtual_slot").orderBy(*order)
    placed = slotted.drop("shard", "slot", "map_version").withColumn("_at", F.row_number().over(inside) - 1)
    # One row per virtual slot, a fixed number: safe to send to every task.
    return (
        placed.join(F.broadcast(known), "virtual_slot")
        .withColumn("slot", (F.col("_first") + F.col("_at")).cast("long"))
        .drop("_first", "_at")
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Documents with shard, position and size under version 1 of a freshly balanced map."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "slot-map")
    slotted = with_slots(docs, n_slots)
    stats = slot_stats(slotted)
    write_map(spark, path, 1, initial_map(stats, n_shards, n_slots), stats)
    order = [c for c in ("doc_id", "text_crc32", "size") if c in slotted.columns]
    return place(slotted, read_map(spark, path, 1), order)
