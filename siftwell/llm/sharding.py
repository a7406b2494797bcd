"""Sharding by fixed virtual slots.

A record's key is hashed into one of SLOTS virtual slots, for ever. Bytes are summed by slot, and a
small versioned map says which shard owns which slot. Rebalancing edits the map: it moves whole
slots and leaves all others where they are; records are never hashed anew.

Every version of the map is stored, and records are assigned from the stored table.

The driver sees one row a slot (SLOTS rows, whatever the input). A null text has no bytes. Rows
without a key are dealt by their texts, as all of them in one slot could not be moved apart. An empty table gives no rows and an even map.
Only the key and text are read, so other columns can't clash. Repeated keys share a slot.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import staged, staging_root

SLOTS = 8192
ROW_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """owner[slot] is the shard of that slot; each edit makes the next version."""

    owner: tuple[int, ...]
    shards: int
    version: int = 1

    @classmethod
    def balanced(cls, sizes: Sequence[int], shards: int) -> SlotMap:
        """A first map: slots by falling size, each to the shard that has least so far."""
        owner = [0] * len(sizes)
        heap = [(0, 0, s) for s in range(shards)]
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            load, count, s = heapq.heappop(heap)
            owner[slot] = s
            heapq.heappush(heap, (load + sizes[slot], count + 1, s))
        return cls(tuple(owner), shards)

    def loads(self, sizes: Sequence[int]) -> list[int]:
        out = [0] * self.shards
        for slot, s in enumerate(self.owner):
            out[s] += sizes[slot]
        return out

    def rebalanced(self, sizes: Sequence[int], tolerance: float = 0.001) -> SlotMap:
        """The next version: slots go from the fullest shard to the emptiest while that narrows the gap."""
        owner, load = list(self.owner), self.loads(sizes)
        of: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, s in enumerate(owner):
            of[s].append(slot)
        mean = sum(load) / self.shards
        while self.shards > 1:
            a, b = max(range(self.shards), key=lambda s: load[s]), min(range(self.shards), key=lambda s: load[s])
            gap = load[a] - load[b]
            if gap <= tolerance * mean:
                break
            fits = [x for x in of[a] if 0 < sizes[x] < gap]
            if not fits:
                break
            x = min(fits, key=lambda x: (abs(2 * sizes[x] - gap), x))
            of[a].remove(x)
            of[b].append(x)
            owner[x] = b
            load[a] -= sizes[x]
            load[b] += sizes[x]
        return SlotMap(tuple(owner), self.shards, self.version + 1)

    def grown(self, sizes: Sequence[int], more: int = 1) -> SlotMap:
        """The next version with further shards; only slots that they take change their owner."""
        owner, load = list(self.owner), [*self.loads(sizes), *[0] * more]
        shards = self.shards + more
        mean = sum(load) / shards
        of: list[list[int]] = [[] for _ in range(shards)]
        for slot, s in enumerate(owner):
            of[s].append(slot)
        for s in range(shards):
            of[s].sort(key=lambda x: (sizes[x], -x))
        for new in range(self.shards, shards):
            while load[new] < mean:
                a = max(range(self.shards), key=lambda s: load[s])
                room = mean - load[new]
                k = next((k for k in range(len(of[a]) - 1, -1, -1) if sizes[of[a][k]] <= room), None)
                if k is None or load[a] <= mean:
                    break
                x = of[a].pop(k)
                owner[x] = new
                load[a] -= sizes[x]
                load[new] += sizes[x]
        return SlotMap(tuple(owner), shards, self.version + 1)

    def rows(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, s) for slot, s in enumerate(self.owner)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table of all versions."""
        self.rows(spark).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the stored map, the newest by default."""
        df = spark.read.parquet(path)
        version = version or df.agg(F.max("version")).first()[0]
        rows = df.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(tuple(r["shard"] for r in rows), rows[0]["shards"], version)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each document."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rec: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: a fixed number of rows for the driver."""
    size, count = [0] * slots, [0] * slots
    for slot, b, n in rec.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[slot], count[slot] = b, n
    return size, count


def stored_map(spark: SparkSession, sizes: Sequence[int], shards: int, store: str, first: bool) -> SlotMap:
    """The newest stored version of the map, edited for these sizes if that moves slots; `first`: there is none yet."""
    if first:
        SlotMap.balanced(sizes, shards).save(spark, store)
    now = SlotMap.load(spark, store)
    edited = now.rebalanced(sizes)
    if edited.owner != now.owner:
        edited.save(spark, store)
    return SlotMap.load(spark, store)


def assign(docs: DataFrame, shards: int, slot_map: SlotMap | None = None, slots: int = SLOTS, store: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Each document's shard and its gapless place in it, and the map used.

    store: a table of map versions that an earlier run has left, to start from and to add to; by
    default a new one in the shared folder. Places are those of its slot in the shard (a prefix sum
    over slots) plus those in the slot, so numbering sorts one slot at a time.
    """
    spark = docs.sparkSession
    rec = staged(records(docs, slots), "slots")
    sizes, counts = slot_sizes(rec, slots)
    if slot_map is None:
        place = store or f"{staging_root(spark)}/slot_map-{uuid.uuid4().hex}"
        slot_map = stored_map(spark, sizes, shards, place, store is None)
    before, so_far = [], [0] * slot_map.shards
    for slot, s in enumerate(slot_map.owner):
        before.append((slot, s, so_far[s]))
        so_far[s] += counts[slot]
    owners = spark.createDataFrame(before, "virtual_slot int, shard int, before long")
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    placed = rec.withColumn("place", place).join(F.broadcast(owners), "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"), "virtual_slot"), slot_map
