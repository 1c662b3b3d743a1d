"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots; a small versioned table maps slots to shards. Rebalancing
edits that table only: the newest stored version is loaded, as few slots move as make the shards' bytes nearly
equal, and the edit is stored as the next version. A version that exists is never written again. The table has
as many rows as there are slots (a parameter), so the driver may hold it and every task may have it.

A record's slot depends on its doc_id, the CRC of its text and, for records that repeat both, on its number
among them; so repeats spread over the slots like other records, and the slots of a table do not depend on
how it is divided into files.

Nulls: a null text has no bytes and the CRC 0; a null doc_id hashes as such. Repeated rows are separate
records. Ties (equal sizes, equal slots) fall by slot number. A very long text is one record of its slot: loads
are equal up to the largest record. Extra columns are ignored. An empty table gives an empty result and leaves
the map as it is.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import scratch, shared_dir

SLOTS, OVERHEAD = 4096, 16


def default_map(n_shards: int, n_slots: int = SLOTS) -> np.ndarray:
    return np.arange(n_slots, dtype=np.int64) % n_shards


def rebalance(slot_map: np.ndarray, slot_bytes: np.ndarray, n_shards: int) -> np.ndarray:
    """An edited copy of the map for n_shards shards, which may be more or fewer than the map has.

    Slots of shards that are no more go to the emptiest, the largest first. Then slots go from the fullest to the
    emptiest shard as long as that narrows the gap: each move takes the slot nearest to half the gap, so the sum
    of squares falls and the loop ends; at its end no slot of the fullest shard is smaller than the gap.
    """
    edited = slot_map.copy()
    homeless = np.flatnonzero(edited >= n_shards)
    kept = edited < n_shards
    load = np.bincount(edited[kept], weights=slot_bytes[kept], minlength=n_shards).astype(np.int64)
    heap = [(int(x), k) for k, x in enumerate(load)]
    heapq.heapify(heap)
    for s in homeless[np.argsort(-slot_bytes[homeless], kind="stable")].tolist():
        size, k = heapq.heappop(heap)
        edited[s] = k
        load[k] += int(slot_bytes[s])
        heapq.heappush(heap, (int(load[k]), k))
    held = [sorted((int(slot_bytes[s]), int(s)) for s in np.flatnonzero(edited == k) if slot_bytes[s]) for k in range(n_shards)]
    while True:
        high, low = int(load.argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        near = [(abs(gap - 2 * size), i) for i, (size, _) in enumerate(held[high]) if size < gap]
        if not near:
            return edited
        size, slot = held[high].pop(min(near)[1])
        load[high] -= size
        load[low] += size
        edited[slot] = low
        held[low].append((size, slot))
        held[low].sort()


def save_map(spark: SparkSession, path: str, version: int, slot_map: np.ndarray) -> None:
    """Adds a version to the stored table; older versions stay readable, one that exists is refused."""
    rows = [(s, int(k)) for s, k in enumerate(slot_map)]
    spark.createDataFrame(rows, "vslot int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def newest_version(spark: SparkSession, path: str) -> int:
    """The newest stored version, 0 if there is none."""
    try:
        maps = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return 0
        raise
    return int(maps.agg(F.max("version")).first()[0] or 0)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(vslot, shard) of a version, the newest by default."""
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version or newest_version(spark, path)}")


def slotted(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the record's virtual slot, as a written table.

    Records are numbered within a partition first; only records that repeat then need the numbers of the earlier
    partitions, of which a record has one row for each partition, not one for each repeat.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = ["doc_id", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    rows = scratch(rows, "records")
    counts = rows.groupBy(*key, "part").agg(F.count("*").alias("n"))
    over = Window.partitionBy(*key)
    counts = counts.withColumns({"base": F.coalesce(F.sum("n").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(over)})
    bases = scratch(counts.where(F.col("all") > 1).select(*(F.col(c).alias(f"r_{c}") for c in key), F.col("part").alias("r_part"), "base"), "repeats")
    same = F.col("part") == F.col("r_part")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    within = Window.partitionBy(*key, "part").orderBy("size")
    many = rows.join(bases, same).withColumn("nth", F.col("base") + F.row_number().over(within) - 1).select("doc_id", "size", "text_crc32", "nth")
    one = rows.join(bases, same, "left_anti").select("doc_id", "size", "text_crc32", F.lit(0).cast("long").alias("nth"))
    slot = F.when(F.col("nth") == 0, F.xxhash64(*key)).otherwise(F.xxhash64(*key, "nth"))
    return scratch(one.unionByName(many).select("doc_id", "size", "text_crc32", F.pmod(slot, F.lit(n_slots)).cast("int").alias("vslot")), "slotted")


def shard(docs: DataFrame, n_shards: int, n_slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record with its shard and its place there.

    One pass over narrow rows sums records and bytes per slot (n_slots rows reach the driver). The newest version of
    the map at map_path is loaded (the default map is stored as version 1 where there is none), edited for n_shards
    shards and stored as the next version if the edit changes it. Places are counted within slots, of which there
    are thousands, then moved by the records of the shard's earlier slots: no task holds a whole shard.
    """
    spark = docs.sparkSession
    rows = slotted(docs, n_slots)
    size, count = np.zeros(n_slots, dtype=np.int64), np.zeros(n_slots, dtype=np.int64)
    for vslot, total, n in rows.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect():
        size[vslot], count[vslot] = total, n
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    version = newest_version(spark, path)
    if not version:
        version = 1
        save_map(spark, path, version, default_map(n_shards, n_slots))
    stored = np.full(n_slots, -1, dtype=np.int64)
    for vslot, k in load_map(spark, path, version).collect():
        stored[vslot] = k
    if (stored < 0).any():
        raise ValueError(f"the map at {path} does not have {n_slots} slots")
    edited = rebalance(stored, size, n_shards)
    if (edited != stored).any():
        version += 1
        save_map(spark, path, version, edited)
    before = np.zeros(n_slots, dtype=np.int64)
    for k in range(n_shards):
        own = np.flatnonzero(edited == k)
        before[own] = np.cumsum(count[own]) - count[own]
    starts = spark.createDataFrame([(s, int(before[s])) for s in range(n_slots)], "vslot int, before long")
    places = load_map(spark, path, version).join(starts, "vslot")
    order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(places), "vslot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).alias("slot"), F.col("vslot").alias("virtual_slot"), F.lit(version).alias("map_version"))
    )
