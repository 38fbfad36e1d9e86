"""Fixed virtual slots and a versioned slot-to-shard map (operator 1).

Records are hashed into thousands of slots, once and for all; only the map from slots to shards
changes. Bytes are added up per slot, and rebalancing edits the newest map: slots move, or trade
places, between the fullest and the emptiest shards until no edit evens them out further. Every version is kept as
rows (version, slot, shard), one per slot, so a map is at most MAX_SLOTS rows of driver memory.

Defined cases: a null key counts as its own value, a null text as no bytes. Rows that are alike in
key and text are counted, not compared: they are dealt in bundles of BUNDLE, each with its own
slot, so that copies can't fill one slot. A very long text is a size, a checksum and a hash like any other. Ties
within a slot are in the order of key and hash. An empty table gives the even first map.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coursepulse.llm.common import shared_folder, stored

SLOTS, MAX_SLOTS = 8_192, 1 << 16
#: Alike records that share a slot.
BUNDLE = 64
#: Edits stop when the fullest and the emptiest shard differ by less than this share of the mean.
TOLERANCE = 1e-4

MAP_SCHEMA = "version int, slot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """One version of the map; shard_of[slot] is the slot's shard."""

    version: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, slots: int, shards: int) -> SlotMap:
        if not 0 < shards <= slots <= MAX_SLOTS:
            raise ValueError(f"between 1 and {MAX_SLOTS} slots, and no more shards than slots")
        return cls(0, tuple(slot % shards for slot in range(slots)))

    @property
    def shards(self) -> int:
        return max(self.shard_of) + 1

    def moved(self, other: SlotMap) -> int:
        """Slots that the two versions place differently."""
        return sum(a != b for a, b in zip(self.shard_of, other.shard_of))

    def rebalanced(self, weight: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version: slots moved or traded between shards until their weights are near equal."""
        shards = shards or self.shards
        shard_of = [s if s < shards else s % shards for s in self.shard_of]
        members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(shard_of):
            if w := weight.get(slot, 0):
                members[shard].append((w, slot))
        for own in members:
            own.sort()
        load = [sum(w for w, _ in own) for own in members]
        close = max(1, int(TOLERANCE * sum(load) / shards))
        for _ in range(64 * len(shard_of)):
            order = sorted(range(shards), key=load.__getitem__)
            low = order[0]
            if load[order[-1]] - load[low] <= close:
                break
            edits = (
                (high, edit)
                for high in reversed(order[1:])
                if (edit := _edit(members[high], members[low], load[high] - load[low]))
            )
            high, (out, back) = next(edits, (low, ([], [])))
            if not out:
                break
            for source, target, items in ((high, low, out), (low, high, back)):
                for item in items:
                    members[source].remove(item)
                    bisect.insort(members[target], item)
                    load[source] -= item[0]
                    load[target] += item[0]
                    shard_of[item[1]] = target
        return SlotMap(self.version + 1, tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, MAP_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map; versions before stay readable."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, else the newest."""
        stored = spark.read.schema(MAP_SCHEMA).parquet(path)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == version).orderBy("slot").collect()
        return cls(version, tuple(r["shard"] for r in rows))


def _edit(high: list, low: list, gap: int):
    """The move or trade that comes nearest to halving the gap: items that go and items that come back."""
    best, cost = None, gap
    i = bisect.bisect_left(high, (gap // 2, -1))
    for k in (i - 1, i):
        if 0 <= k < len(high) and (c := abs(gap - 2 * high[k][0])) < cost:
            best, cost = ([high[k]], []), c
    for item in low if cost > gap // 4 else ():
        i = bisect.bisect_left(high, (item[0] + gap // 2, -1))
        for k in (i - 1, i):
            if 0 <= k < len(high) and (c := abs(gap - 2 * (high[k][0] - item[0]))) < cost:
                best, cost = ([high[k]], [item]), c
    return best


def slot(*keys: str | Column, slots: int = SLOTS) -> Column:
    """A record's slot; depends on its keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_totals(bundles: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Bytes and rows of each slot: at most MAX_SLOTS numbers each."""
    total = F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")
    found = bundles.groupBy("virtual_slot").agg(*total).collect()
    return {r[0]: int(r["bytes"]) for r in found}, {r[0]: int(r["rows"]) for r in found}


def with_shard(df: DataFrame, slot_map: SlotMap, slot_col: str = "virtual_slot", name: str = "shard") -> DataFrame:
    """df with the shard of each row's slot. The broadcast map has MAX_SLOTS rows at most."""
    own = slot_map.frame(df.sparkSession).select(F.col("slot").alias(slot_col), F.col("shard").alias(name))
    return df.join(F.broadcast(own), slot_col)


def deal(spark: SparkSession, docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every document with size, checksum, shard and its place in the shard, by bytes.

    Two versions of the map are stored at `path`: the even first one, and its rebalanced successor. Texts are
    read once; what is left of them is stored in the shared folder.
    """
    path = path or shared_folder(spark, "slot_map")
    bundles = stored(_bundles(docs, slots), "bundles")
    weights, counts = slot_totals(bundles)
    first = SlotMap.first(slots, shards)
    first.save(spark, path)
    first.rebalanced(weights, shards).save(spark, path)
    return placed(bundles, SlotMap.load(spark, path), counts)


def _bundles(docs: DataFrame, slots: int) -> DataFrame:
    """Records that are alike, in bundles: doc_id, size, text_crc32, n, virtual_slot."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    alike = rows.groupBy("doc_id", "size", "text_crc32", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    last = F.floor((F.col("copies") - 1) / BUNDLE)
    return (
        alike.withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("n", F.least(F.lit(BUNDLE), F.col("copies") - F.col("bundle") * BUNDLE))
        .withColumn("virtual_slot", slot("doc_id", "text_hash", "bundle", slots=slots))
        .drop("copies")
    )


def placed(bundles: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Bundles laid out row by row, each with its shard and a place in it, gapless from 0.

    Places follow the slots of the shard and the order within each slot: rows are numbered slot by
    slot, and one row per slot tells how many rows the shard's earlier slots hold.
    """
    within = W.partitionBy("virtual_slot").orderBy("doc_id", "text_hash", "bundle")
    numbered = bundles.withColumn("upto", F.sum("n").over(within))
    before, filled = [], [0] * slot_map.shards
    for s, shard in enumerate(slot_map.shard_of):
        before.append((s, shard, filled[shard]))
        filled[shard] += counts.get(s, 0)
    starts = bundles.sparkSession.createDataFrame(before, "virtual_slot int, shard int, before long")
    start = F.col("before") + F.col("upto") - F.col("n")
    return numbered.join(F.broadcast(starts), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.explode(F.sequence(start, start + F.col("n") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )
