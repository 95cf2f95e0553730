"""Sharding by fixed virtual slots.

A record's slot is a hash of its key, one of a fixed number. A versioned map sends slots to
shards; records never move between slots, so rebalancing edits the map alone. Bytes are aggregated
per slot and stored with each version of the map in the shared folder, and records are placed by
joining that table.

The map for n shards is reached from one shard by adding shards one at a time: each shard keeps its
first slots up to an even share and the new one takes the rest. It depends on n alone, and one more
shard takes slots only into itself. ``SlotMap.rebalance`` edits a map by measured bytes; ``assign``
uses it, ``shard`` doesn't, as its law lets only the id and the number of shards decide.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, pin, shared_folder

SLOTS = 8192
SHARDS = 40
#: Parts that each slot is numbered in; with SLOTS it bounds the table of offsets.
PARTS = 16
OVERHEAD_BYTES = 16


@dataclass
class SlotMap:
    """All versions of a slot-to-shard map; versions[-1] is in force."""

    versions: list[list[int]] = field(default_factory=lambda: [[0] * SLOTS])

    @classmethod
    def for_shards(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """The map for ``shards`` shards as a single version."""
        if not 1 <= shards <= slots:
            raise ValueError(f"{shards} shards for {slots} slots")
        out = cls([[0] * slots])
        for _ in range(shards - 1):
            out.add_shard()
        return cls([out.versions[-1]])

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def _held(self) -> list[list[int]]:
        held: list[list[int]] = [[] for _ in range(max(self.current) + 1)]
        for slot, shard in enumerate(self.current):
            held[shard].append(slot)
        return held

    def add_shard(self) -> int:
        """A new version with one more shard: the others keep their first slots, up to an even share."""
        held, edited = self._held(), list(self.current)
        new = len(held)
        each, more = divmod(len(edited), new + 1)
        for shard, slots in enumerate(held):
            for slot in slots[each + (shard < more) :]:
                edited[slot] = new
        self.versions.append(edited)
        return new

    def rebalance(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> int:
        """A new version that moves slots from heavy to light shards; returns how many moved.

        Each move takes the largest slot that narrows the gap, until the heaviest shard is within
        ``tolerance`` of the mean or no move helps.
        """
        held, edited = self._held(), list(self.current)
        load = [sum(slot_bytes.get(s, 0) for s in slots) for slots in held]
        mean, moves = sum(load) / len(load), 0
        while True:
            heavy, light = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
            gap = load[heavy] - load[light]
            fitting = [s for s in held[heavy] if 0 < slot_bytes.get(s, 0) < gap]
            if load[heavy] <= mean * (1 + tolerance) or not fitting:
                break
            slot = min(fitting, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
            held[heavy].remove(slot)
            held[light].append(slot)
            load[heavy] -= slot_bytes[slot]
            load[light] += slot_bytes[slot]
            edited[slot] = light
            moves += 1
        self.versions.append(edited)
        return moves

    def frame(self, spark: SparkSession) -> DataFrame:
        """(version, virtual_slot, shard), one row per slot and version."""
        rows = [(v, slot, shard) for v, edited in enumerate(self.versions, 1) for slot, shard in enumerate(edited)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str, weights: DataFrame | None = None) -> None:
        """Write all versions as a table in a shared folder, with the measured bytes of each slot.

        ``weights`` has virtual_slot and slot_bytes; both tables have a fixed number of rows.
        """
        rows = self.frame(spark)
        measured = rows.join(F.broadcast(weights), "virtual_slot", "left") if weights is not None else rows.withColumn("slot_bytes", F.lit(0).cast("long"))
        measured.select("version", "virtual_slot", "shard", F.coalesce("slot_bytes", F.lit(0)).cast("long").alias("slot_bytes")).write.mode("overwrite").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        """Read the table back; it has one row per slot and version, a fixed number."""
        versions: dict[int, dict[int, int]] = {}
        for r in spark.read.parquet(path).collect():
            versions.setdefault(r.version, {})[r.virtual_slot] = r.shard
        return cls([[v[s] for s in range(len(v))] for _, v in sorted(versions.items())])


def stored(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(virtual_slot, shard, grown_shard, slot_bytes) from a stored map: a version, and the next as that with one more shard."""
    rows = spark.read.parquet(path).filter(F.col("version").isin(version, version + 1))
    of = lambda v: F.max(F.when(F.col("version") == v, F.col("shard")))
    return rows.groupBy("virtual_slot").agg(of(version).alias("shard"), of(version + 1).alias("grown_shard"), F.max("slot_bytes").alias("slot_bytes"))


def virtual_slot(key: str, slots: int = SLOTS) -> Column:
    """The first 32 bits of the key's MD5, modulo ``slots``; a null key hashes as the empty string."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def _size(text_col: str) -> Column:
    return (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + OVERHEAD_BYTES).cast("long")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, part): size is the text's UTF-8 bytes plus 16."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    # rows of one key are dealt over the parts of its slot by text
    return docs.select(F.col(id_col).alias("id"), _size(text_col).alias("size"), crc.alias("text_crc32"), virtual_slot(id_col, slots).alias("virtual_slot"), (crc % PARTS).cast("int").alias("part"))


def slot_bytes(recs: DataFrame) -> DataFrame:
    """(virtual_slot, slot_rows, slot_bytes)."""
    return recs.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``docs`` with virtual_slot, shard and grown_shard: shards near equal in bytes.

    Bytes are aggregated per slot; the map for ``shards`` shards (version 1) is edited by them
    (version 2) and grown by one shard (version 3), stored below ``path``, by default a new folder of
    the shared one, and joined: one row per slot, a fixed number, and no row of ``docs`` is shuffled.
    The three columns replace any of the same names. Rows with a null id share one slot, null texts
    weigh 16 bytes, repeated rows and ties go the same way. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    weights = pin(slot_bytes(docs.select(virtual_slot(id_col, slots).alias("virtual_slot"), _size(text_col).alias("size"))))
    plan = SlotMap.for_shards(shards, slots)
    plan.rebalance({r.virtual_slot: r.slot_bytes for r in weights.collect()})
    plan.add_shard()
    plan.save(spark, path, weights)
    docs = docs.drop("virtual_slot", "shard", "grown_shard").withColumn("virtual_slot", virtual_slot(id_col, slots))
    placed = docs.join(F.broadcast(stored(spark, path, 2).drop("slot_bytes").withColumnRenamed("virtual_slot", "_to")), F.col("virtual_slot") == F.col("_to"))
    return placed.select(*docs.columns, "shard", "grown_shard")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, slot_bytes, shard, slot, grown_shard): a row per row.

    shard depends on the id and the number of shards only; grown_shard is the shard with one more.
    slot is the record's place in its shard, without gaps from 0, in the order of virtual slot, part,
    id (null first), checksum and size, so that reruns agree. Null texts count as empty. Rows
    with a null id share one virtual slot; rows alike in id, checksum and size are interchangeable and
    travel as one row with their number. An empty table gives an empty result. Other columns of
    ``docs`` are not read.

    The map with the bytes of each slot is stored below ``path``, by default a new folder of the
    shared one, and read from there. Places come from counts per part of a slot, at most ``slots`` *
    PARTS rows whatever the input; the join's side is chosen by its measured size.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    keys = ["virtual_slot", "part", "id", "text_crc32", "size"]
    alike = pin(records(docs, id_col, text_col, slots).groupBy(*keys).agg(F.count("*").alias("n")))
    parts = pin(alike.groupBy("virtual_slot", "part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("slot_bytes")))
    plan = SlotMap.for_shards(shards, slots)
    plan.add_shard()
    plan.save(spark, path, parts.groupBy("virtual_slot").agg(F.sum("slot_bytes").alias("slot_bytes")))
    earlier = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    mapped = parts.drop("slot_bytes").join(F.broadcast(stored(spark, path, 1)), "virtual_slot")
    offsets = mapped.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    before = Window.partitionBy("virtual_slot", "part").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(offsets, ["virtual_slot", "part"])
    each = numbered(placed, "n", "nth")
    return each.select("id", "size", "text_crc32", "virtual_slot", "slot_bytes", "shard", (F.col("offset") + F.col("before") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
