"""Shards by fixed virtual slots.

Records are hashed into a fixed number of slots. Bytes and rows are summed per slot, and a stored, versioned map says
which shard holds each slot. Rebalancing edits the map: whole slots move, records keep their slot for good.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot, in one version. At most as many entries as slots."""

    version: int
    shards: int
    shard_of: dict[int, int]

    def save(self, spark: SparkSession, folder: str, size: dict[int, int] | None = None) -> None:
        """Add this version, and the bytes of each slot it was made for, to the folder; a version that exists is an error."""
        rows = [(s, k, self.shards, (size or {}).get(s, 0)) for s, k in sorted(self.shard_of.items())]
        spark.createDataFrame(rows, "slot int, shard int, shards int, bytes long").coalesce(1).write.mode("error").parquet(f"{folder}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version}").collect()
        return SlotMap(version, rows[0]["shards"], {r["slot"]: r["shard"] for r in rows})


def rebalance_stored(spark: SparkSession, folder: str, shards: int, size: dict[int, int] | None = None) -> SlotMap:
    """Edit the newest map of a folder for ``shards`` shards, add it as the next version and return it as loaded.

    ``size`` are the bytes of each slot now; if not given, those stored with the map.
    """
    newest = spark.read.parquet(folder).agg(F.max("version")).first()[0]
    if size is None:
        size = {r["slot"]: r["bytes"] for r in spark.read.parquet(f"{folder}/version={newest}").collect()}
    rebalanced(SlotMap.load(spark, folder, newest), size, shards).save(spark, folder, size)
    return SlotMap.load(spark, folder, newest + 1)


def placed(rows: DataFrame, slot_map: SlotMap, name: str = "shard") -> DataFrame:
    """Rows with the shard that a map gives to their virtual_slot, as column ``name``."""
    table = rows.sparkSession.createDataFrame(sorted(slot_map.shard_of.items()), f"virtual_slot int, `{name}` int")
    # One row per slot: bounded by the number of slots.
    return rows.join(F.broadcast(table), "virtual_slot")


def loads(shard_of: dict[int, int], size: dict[int, int], shards: int) -> list[int]:
    total = [0] * shards
    for slot, shard in shard_of.items():
        total[shard] += size.get(slot, 0)
    return total


def first_map(size: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Slots in descending order of their bytes, each to the shard with the fewest so far."""
    heap, shard_of = [(0, k) for k in range(shards)], {}
    for slot in sorted(range(slots), key=lambda s: (-size.get(s, 0), s)):
        total, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        # An empty slot counts a little, so that slots without records are spread as well.
        heapq.heappush(heap, (total + size.get(slot, 0), shard))
    return SlotMap(1, shards, shard_of)


def rebalanced(old: SlotMap, size: dict[int, int], shards: int, tolerance: float = 0.01) -> SlotMap:
    """The next version for ``shards`` shards: slots of closed shards and the excess of full ones move, no others."""
    if shards < 1:
        raise ValueError("one shard at least")
    target = sum(size.values()) / shards
    shard_of = {s: k for s, k in old.shard_of.items() if k < shards}
    homeless = [s for s in old.shard_of if s not in shard_of]
    total = loads(shard_of, size, shards)
    for shard in range(shards):
        for slot in sorted((s for s, k in shard_of.items() if k == shard), key=lambda s: (size.get(s, 0), s)):
            if total[shard] <= target * (1 + tolerance):
                break
            if total[shard] - size.get(slot, 0) >= target * (1 - tolerance):
                total[shard] -= size.get(slot, 0)
                homeless.append(slot)
                del shard_of[slot]
    for slot in sorted(homeless, key=lambda s: (-size.get(s, 0), s)):
        shard = min(range(shards), key=lambda k: (total[k], k))
        shard_of[slot] = shard
        total[shard] += size.get(slot, 0)
    return SlotMap(old.version + 1, shards, shard_of)


def with_slots(docs: DataFrame, doc_id: str, text: str, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one), text_crc32 and virtual_slot of every row."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows): at most one entry per slot reaches the driver."""
    summed = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in summed.collect()}


def assign(rows: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Adds shard and slot, the gapless position of the row within its shard.

    The slots of a shard follow each other by number; within a slot rows are ordered by id, size and checksum. Rows
    that are equal in all of these are alike in every column returned, so their order is of no consequence.
    """
    places, reached = [], [0] * slot_map.shards
    for slot, shard in sorted(slot_map.shard_of.items()):
        places.append((slot, shard, reached[shard]))
        reached[shard] += counts.get(slot, 0)
    table = rows.sparkSession.createDataFrame(places, "virtual_slot int, shard int, first long")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("_nth", F.row_number().over(within) - 1)
    # One row per slot: bounded by the number of slots.
    return numbered.join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("first") + F.col("_nth")).drop("first", "_nth")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows with size, text_crc32, virtual_slot, shard and slot, balanced by bytes, and the map used.

    With a ``folder`` the map is saved there as version 1, and rows are assigned from what is loaded.

    One row per row of ``docs``. A null text has size 1; null ids share one slot; repeated rows share a slot and are
    numbered one after the other. An empty table gives no rows and a map without bytes. Other columns are not read.
    """
    rows = with_slots(docs, doc_id, text, slots)
    sizes = slot_sizes(rows)
    size = {s: b for s, (b, _) in sizes.items()}
    slot_map = first_map(size, shards, slots)
    if folder:
        slot_map.save(docs.sparkSession, folder, size)
        slot_map = SlotMap.load(docs.sparkSession, folder, slot_map.version)
    return assign(rows, slot_map, {s: n for s, (_, n) in sizes.items()}), slot_map
