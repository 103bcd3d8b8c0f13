"""Sharding over fixed virtual slots with a stored, versioned slot-to-shard map.

The map is a small table with one row per slot in ``<path>/version=<n>``. A version never changes: a corpus that
has grown, or one more shard, edits the newest one and stores the result as the next, so that records only move
with the slots that were edited.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm.common import blank
from sigmill.session import cut, scratch_dir

#: Virtual slots. The slot of a record never changes; the map below has one row per slot and so is bounded.
SLOTS = 16_384
#: Rebalancing stops when the largest and smallest shard differ by less than this part of the mean.
TOLERANCE = 0.0005
MAP_SCHEMA = "vslot int, shard int"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot``; size is the UTF-8 bytes of the text plus 16."""
    text = blank()
    return docs.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_stats(recs: DataFrame) -> DataFrame:
    return recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 0: contiguous ranges of slots."""
    return [v * shards // slots for v in range(slots)]


def rebalance(current: list[int], sizes: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map with edits: slots move, or trade places, from the fullest shard to the emptiest until they are near equal.

    Each edit takes the move or exchange that brings the two shards closest together, so few slots move.
    A single slot larger than the mean can't be split, since a record can't.
    """
    new, load = list(current), [0] * shards
    members: list[dict[int, None]] = [{} for _ in range(shards)]
    for v, s in enumerate(new):
        load[s] += sizes[v]
        members[s][v] = None
    mean = sum(load) / shards
    for _ in range(4 * len(current)):
        hi = max(range(shards), key=load.__getitem__)
        lo = min(range(shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        if gap <= tolerance * mean:
            break
        half = gap / 2
        best = min(((abs(sizes[v] - half), v, -1) for v in members[hi] if 0 < sizes[v] < gap), default=(half, -1, -1))
        if best[0] > half / 4:
            out, into = (sorted((sizes[v], v) for v in members[s]) for s in (hi, lo))
            j = 0
            for size, v in out:
                while j + 1 < len(into) and abs(size - into[j + 1][0] - half) <= abs(size - into[j][0] - half):
                    j += 1
                if into and 0 < size - into[j][0] < gap:
                    best = min(best, (abs(size - into[j][0] - half), v, into[j][1]))
        if best[1] < 0 or best[0] >= half:
            break
        for v, a, b in ((best[1], hi, lo), (best[2], lo, hi)):
            if v >= 0:
                new[v] = b
                del members[a][v]
                members[b][v] = None
                load[a] -= sizes[v]
                load[b] += sizes[v]
    return new


def add_shard(current: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map edited for one more shard: slots move only into it, from the fullest shards first."""
    new, load = list(current), [0] * shards
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for v, s in enumerate(new):
        load[s] += sizes[v]
        members[s].append((sizes[v], v))
    for m in members:
        m.sort()
    want, got = sum(load) / (shards + 1), 0
    heap = [(-load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    while heap and got < want:
        _, s = heapq.heappop(heap)
        if not members[s]:
            continue
        size, v = members[s].pop()
        if got + size > want + size / 2:
            continue
        new[v], got = shards, got + size
        load[s] -= size
        heapq.heappush(heap, (-load[s], s))
    return new


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the map under ``path``, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def _store(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    # Fails if somebody else has stored this version.
    spark.createDataFrame(list(enumerate(slot_map)), MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")


def edited_map(spark: SparkSession, path: str, stats: DataFrame, shards: int, slots: int = SLOTS) -> int:
    """Bring the newest stored map up to date with the slots' bytes and the number of shards; returns its version.

    Without a stored map, version 0 holds contiguous ranges of slots. Each shard more is an edit of its own, and so
    is rebalancing; an edit that changes nothing stores nothing. ``stats`` has at most ``slots`` rows, as the map
    does; nothing that grows with the records reaches the driver.
    """
    sizes = [0] * slots
    for r in stats.select("vslot", "bytes").collect():
        sizes[r[0]] = r[1]
    known = stored_versions(spark, path)
    if known:
        version = known[-1]
        current = [r["shard"] for r in stored_map(spark, path, version).orderBy("vslot").collect()]
        if len(current) != slots or max(current) >= shards:
            raise ValueError(f"the stored map has {len(current)} slots and {max(current) + 1} shards")
    else:
        version, current = 0, first_map(slots, shards)
        _store(spark, path, version, current)
    while True:
        have = max(current) + 1
        new = add_shard(current, sizes, have) if have < shards else rebalance(current, sizes, shards)
        if new == current:
            return version
        version, current, last = version + 1, new, have >= shards
        _store(spark, path, version, current)
        if last:
            return version


def place(recs: DataFrame, slot_map: DataFrame, stats: DataFrame) -> DataFrame:
    """Each record's shard by the map, and its place in the shard, gapless from 0.

    A place is the number of records in the shard's earlier virtual slots plus the rank in its own, so no
    task orders a whole shard.
    """
    offsets = slot_map.join(stats, "vslot").select(
        "vslot",
        "shard",
        (F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        recs.withColumn("rank", rank)
        .join(F.broadcast(offsets), "vslot")  # one row per virtual slot
        .select("doc_id", "size", "text_crc32", "shard", (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).alias("slot"), "vslot")
    )


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, vslot, map_version``: shards of near equal bytes.

    The map is kept under ``path``: a later call starts from what this one stores. Without a path it is a new one
    in the session's shared folder.

    Rows that repeat an id with an equal text share a virtual slot and so a shard; each has its own place.
    Copies under other ids spread over the slots. Empty table: no rows.
    """
    recs = cut(records(docs, slots), "records")
    stats = slot_stats(recs)
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "slot-map")
    version = edited_map(spark, path, stats, shards, slots)
    return place(recs, stored_map(spark, path, version), stats).withColumn("map_version", F.lit(version))
