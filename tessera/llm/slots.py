"""Shards of near equal bytes by fixed virtual slots and a versioned map.

Rows are hashed into a fixed number of slots, bytes and rows are added up for each
slot, and a small table says which shard holds which slot. Rebalancing edits that
table: slots move from full shards to empty ones, one by one or in exchange, and
the edited table is stored as a new version beside the older ones. Rows never need
to be looked at again for that, and all of a slot's rows move together.

Equal rows are counted before the first shuffle, and copies beyond ``COPIES`` are
entries of their own in other slots, so that no slot has to hold a hot row's copies.
On the driver there are only totals by slot (4,096 rows, more beyond 4 billion rows).

Defined results: a null text has no bytes (size 1) and the checksum of the empty
text; null ids hash alike and are kept; repeated rows are rows; empty tables give
an empty result and a map of the first version; extra columns don't matter.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, shared_dir, table, text_bytes, written

SLOTS, SHARDS = 4096, 16
#: Equal rows in one entry, and rows numbered by one task, at most.
COPIES, NUMBERED = 1_000, 1_000_000


def slot_of(*columns, slots: int = SLOTS):
    """The virtual slot of a row: a hash of its key columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def size_of(text: str = "text"):
    """UTF-8 bytes of a text and one; null is empty."""
    return (F.octet_length(text_bytes(text)) + 1).cast("long")


def entries(docs: DataFrame, slots: int = SLOTS, copies: int = COPIES) -> DataFrame:
    """doc_id, size, text_crc32, copies and virtual_slot of equal rows, in parts of ``copies`` rows."""
    rows = docs.select(F.col("doc_id").cast("long"), size_of().alias("size"), F.crc32(text_bytes()).alias("text_crc32"))
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    zero, last = F.lit(0).cast("long"), F.floor((F.col("n") - 1) / copies)
    parts = equal.withColumn("part", F.explode(F.sequence(zero, last)))
    here = F.when(F.col("part") < F.floor((F.col("n") - 1) / copies), F.lit(copies).cast("long")).otherwise(F.col("n") - F.col("part") * copies)
    return parts.select("doc_id", "size", "text_crc32", "part", here.alias("copies"), slot_of("doc_id", "size", "text_crc32", "part", slots=slots).alias("virtual_slot"))


@dataclass
class SlotMap:
    """Which shard holds each slot; a version is never changed, only followed by another."""

    shard: np.ndarray
    shards: int
    version: int = 1
    moved: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def even(slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        """The first version: slots dealt in turn."""
        return SlotMap(np.arange(slots) % shards, shards)

    def loads(self, weight: np.ndarray) -> np.ndarray:
        """Sum of weights in each shard."""
        return np.bincount(self.shard, weights=weight, minlength=self.shards).astype(np.int64)

    def _after(self, shard: np.ndarray, shards: int) -> SlotMap:
        return SlotMap(shard, shards, self.version + 1, np.flatnonzero(shard != self.shard))

    def rebalanced(self, weight: np.ndarray, tolerance: int = 0) -> SlotMap:
        """The next version: slots of the fullest shard move to the emptiest, or change places with its slots, while the two come closer.

        Each edit takes the slot, or the two, that come nearest to half the gap.
        The sum of squares falls with each edit, so that edits end.
        """
        shard, load = self.shard.copy(), self.loads(weight)
        weight = weight.astype(np.int64)
        while True:
            high, low = int(load.argmax()), int(load.argmin())
            gap = int(load[high] - load[low])
            if gap <= max(tolerance, 1):
                break
            ours, theirs = np.flatnonzero((shard == high) & (weight > 0)), np.flatnonzero(shard == low)
            # nothing in return, or the slot there that leaves about half the gap
            returned = np.concatenate([[0], weight[theirs]])
            order = np.argsort(returned, kind="stable")
            at = np.searchsorted(returned[order], weight[ours] - gap / 2)
            best = (gap, -1, -1)
            for side in (at - 1, at):
                pick = order[np.clip(side, 0, len(order) - 1)]
                moved = weight[ours] - returned[pick]
                miss = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), gap)
                k = int(miss.argmin()) if len(miss) else -1
                if k >= 0 and miss[k] < best[0]:
                    best = (int(miss[k]), int(ours[k]), int(pick[k]) - 1)
            if best[1] < 0:
                break
            shard[best[1]] = low
            if best[2] >= 0:
                shard[theirs[best[2]]] = high
            moved = int(weight[best[1]] - (weight[theirs[best[2]]] if best[2] >= 0 else 0))
            load[high] -= moved
            load[low] += moved
        return self._after(shard, self.shards)

    def grown(self, weight: np.ndarray) -> SlotMap:
        """The next version, with one more shard: it takes slots of the fullest shards, largest first, up to a fair share; no other slot moves."""
        shard, load, new = self.shard.copy(), np.concatenate([self.loads(weight), [0]]), self.shards
        fair = int(weight.sum()) // (self.shards + 1)
        heavy = [sorted(np.flatnonzero(shard == k).tolist(), key=lambda s: (-int(weight[s]), s)) for k in range(new)]
        while True:
            full = int(load[:new].argmax())
            fits = next((s for s in heavy[full] if 0 < weight[s] <= fair - load[new]), None)
            if fits is None or load[full] <= fair:
                return self._after(shard, new + 1)
            heavy[full].remove(fits)
            shard[fits] = new
            load[full] -= weight[fits]
            load[new] += weight[fits]


class SlotMaps:
    """Versions of a map in a shared folder, each a small Parquet file that is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def store(self, slot_map: SlotMap, weight: np.ndarray, rows: np.ndarray) -> None:
        """Add a version; one that is there already is an error and stays as it is."""
        columns = zip(range(len(slot_map.shard)), slot_map.shard.tolist(), weight.tolist(), rows.tolist(), np.isin(np.arange(len(slot_map.shard)), slot_map.moved).tolist(), strict=True)
        kinds = "virtual_slot int, shard int, bytes long, rows long, moved boolean"
        self.spark.createDataFrame(list(columns), kinds).withColumn("shards", F.lit(slot_map.shards)).coalesce(1).write.parquet(f"{self.path}/version={slot_map.version}")

    def read(self) -> DataFrame:
        """All versions: version, virtual_slot, shard, bytes, rows, moved, shards."""
        return self.spark.read.parquet(self.path)

    def latest(self) -> SlotMap:
        """The newest version."""
        return self.at(self.read().agg(F.max("version")).first()[0])

    def at(self, version: int) -> SlotMap:
        found = self.read().where(F.col("version") == version).orderBy("virtual_slot").select("shard", "moved", "shards").collect()
        return SlotMap(np.array([r["shard"] for r in found]), found[0]["shards"], version, np.flatnonzero([r["moved"] for r in found]))


def slot_totals(rows: DataFrame, slots: int = SLOTS, subs: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot and part of a slot; ``rows`` has virtual_slot, sub, size and copies."""
    total, count = np.zeros((slots, subs), np.int64), np.zeros((slots, subs), np.int64)
    found = rows.groupBy("virtual_slot", "sub").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n"))
    for r in found.collect():  # a row for each slot and part of a slot
        total[r["virtual_slot"], r["sub"]], count[r["virtual_slot"], r["sub"]] = r["b"], r["n"]
    return total, count


def shard_rows(docs: DataFrame, maps: SlotMaps, shards: int = SHARDS, slots: int = SLOTS, copies: int = COPIES, numbered: int = NUMBERED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (the row's number in its shard), virtual_slot and map_version of each row.

    The first map deals slots in turn; the second is rebalanced by bytes. Both are
    stored in ``maps``, and rows are placed by the version read back.
    """
    spark = docs.sparkSession
    found = written(entries(docs, slots, copies), "slot-entries")
    # parts of a slot, so that one task numbers a bounded number of rows
    subs = max(1, -(-found.count() // (slots * numbered)))
    found = found.withColumn("sub", F.pmod(F.xxhash64(F.lit("sub"), "doc_id", "size", "text_crc32", "part"), F.lit(subs)).cast("int"))
    weight, count = slot_totals(found, slots, subs)
    first = SlotMap.even(slots, shards)
    maps.store(first, weight.sum(1), count.sum(1))
    maps.store(first.rebalanced(weight.sum(1)), weight.sum(1), count.sum(1))
    now = maps.latest()
    # where the rows of each slot begin in its shard: by slot, then part
    begins = np.zeros((slots, subs), np.int64)
    for k in range(shards):
        mine = np.flatnonzero(now.shard == k)
        ends = np.cumsum(count[mine].ravel())
        begins[mine] = (ends - count[mine].ravel()).reshape(len(mine), subs)
    places = [(s, u, int(now.shard[s]), int(begins[s, u])) for s in range(slots) for u in range(subs) if count[s, u]]
    places = spark.createDataFrame(places, "virtual_slot int, sub int, shard int, begin long")
    before = "coalesce(sum(copies) over (partition by virtual_slot, sub order by doc_id, size, text_crc32, part rows between unbounded preceding and 1 preceding), 0)"
    placed = found.selectExpr("*", f"{before} as before").join(places, ["virtual_slot", "sub"])
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.col("shard"), (F.col("begin") + F.col("before") + F.col("nth")).alias("slot"), "virtual_slot", F.lit(now.version).alias("map_version"))


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str) -> None:
    """All columns of ``docs`` as Parquet, one folder ``shard=`` for each shard, by a stored map.

    Only the map is sent to the tasks, a row for each slot. Of more than ``COPIES``
    equal rows all are where the first of them is.
    """
    at, to = fresh(docs, "virtual_slot", "shard")
    places = docs.sparkSession.createDataFrame(list(enumerate(slot_map.shard.tolist())), f"{at} int, {to} int")
    slot = slot_of(F.col("doc_id").cast("long"), size_of(), F.crc32(text_bytes()), F.lit(0).cast("long"), slots=len(slot_map.shard))
    docs.withColumn(at, slot).join(F.broadcast(places), at).drop(at).write.partitionBy(to).option("compression", "zstd").parquet(path)


def op11_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, by bytes."""
    maps = SlotMaps(spark, f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}")
    out = shard_rows(table(spark, sf_dir, "documents"), maps)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
