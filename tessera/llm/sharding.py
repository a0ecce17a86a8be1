"""Sharding by fixed virtual slots.

A record hashes into one of a fixed number of virtual slots; bytes are
aggregated per slot, and a versioned slot-to-shard map - at most one row per
slot - says where each slot lives.  Rebalancing and growing edit the map, so
only the records of moved slots move.  All work on records is native; only the
map (``slots`` rows) is handled on the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep
from tessera.session import scratch_path

SLOTS = 4096


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32, vslot (a hash of the id and the text's checksum)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rec = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                    F.crc32(text).cast("long").alias("text_crc32"))
    return rec.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def stored_records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``records``, written once; rows that are repeated more often than a slot has rows on average get slots of their own.

    An (id, checksum) with more than the mean number of rows a slot and 16
    more is spread by the number of the written row: at most ``slots`` such
    keys exist, and they are counted only in slots of over four times the mean.
    """
    spark = df.sparkSession
    rec = keep(spark, records(df, id_col, text_col, slots).withColumn("row", F.monotonically_increasing_id()), "shard-records")
    counts = rec.groupBy("vslot").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per slot
    mean = sum(r["n"] for r in counts) / slots
    full = [r["vslot"] for r in counts if r["n"] > 4 * mean + 16]
    if not full:
        return rec.drop("row")
    hot = (rec.where(F.col("vslot").isin(full)).groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > mean + 16).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.lit(True).alias("__hot")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_crc32") == F.col("__crc"))
    spread = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(slots)).cast("int")
    marked = rec.join(F.broadcast(hot), same, "left").withColumn("vslot", F.when(F.col("__hot"), spread).otherwise(F.col("vslot")))
    return marked.drop("row", "__id", "__crc", "__hot")


def slot_loads(rec: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """Bytes of every slot, empty ones too (driver data bounded by the number of slots)."""
    got = {r["vslot"]: int(r["bytes"]) for r in rec.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}
    return [(s, got.get(s, 0)) for s in range(slots)]


def balanced_map(loads: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Slot -> shard, heaviest slot first to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + load, shard))
    return out


def rebalance(slot_map: dict[int, int], loads: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The map after moving slots from the heaviest to the lightest shard while that narrows the gap between them."""
    load, out = dict(loads), dict(slot_map)
    total = [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in out.items():
        total[shard] += load.get(slot, 0)
        members[shard].add(slot)
    while True:
        hi, lo = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[hi] - total[lo]
        movable = [s for s in members[hi] if 0 < load.get(s, 0) < gap]
        if not movable:
            return out
        slot = min(movable, key=lambda s: (abs(gap / 2 - load[s]), s))
        members[hi].discard(slot)
        members[lo].add(slot)
        out[slot] = lo
        total[hi] -= load[slot]
        total[lo] += load[slot]


def grow(slot_map: dict[int, int], loads: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The map for ``shards`` + 1 shards: slots move into the new shard only."""
    load, out = dict(loads), dict(slot_map)
    total = [0] * (shards + 1)
    members: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in out.items():
        total[shard] += load.get(slot, 0)
        members[shard].append(slot)
    fair = sum(total) / (shards + 1)
    for m in members:
        m.sort(key=lambda s: (load.get(s, 0), -s))
    while True:
        donor = max(range(shards), key=lambda s: (total[s], -s))
        fits = [s for s in members[donor] if 0 < load.get(s, 0) <= fair - total[shards]]
        if total[donor] <= fair or not fits:
            return out
        over = total[donor] - fair
        slot = min(fits, key=lambda s: (abs(load[s] - over), s))
        members[donor].remove(slot)
        out[slot] = shards
        total[donor] -= load[slot]
        total[shards] += load[slot]


def store_map(spark: SparkSession, slot_map: dict[int, int], path: str, version: int) -> DataFrame:
    """Append one version of the map to its table and read that version back."""
    rows = [(version, slot, shard) for slot, shard in sorted(slot_map.items())]
    (spark.createDataFrame(rows, "version int, vslot int, shard int").coalesce(1)
     .write.mode("append").parquet(path))
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """vslot, shard of a version (default: the newest)."""
    table = spark.read.schema("version int, vslot int, shard int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version).select("vslot", "shard")


def place(rec: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot, the record's gapless position in its shard.

    Records are numbered per virtual slot (by id, then checksum); the counts
    of the shard's earlier slots - a table of at most ``slots`` rows - are added.
    """
    sizes = rec.groupBy("vslot").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(slot_map), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32")
    numbered = rec.withColumn("k", F.row_number().over(inside) - 1)
    return (numbered.join(F.broadcast(base), "vslot")  # one row per virtual slot
            .withColumn("slot", (F.col("base") + F.col("k")).cast("long")).drop("base", "k"))


def shard_by_bytes(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                   slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row with its shard under the law ``bytes``: shard sizes near equal.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null
    under this law), virtual_slot, map_version.  Null text: size 1, checksum of
    the empty text; null ids are hashed by their text; repeated rows take
    different positions, and often repeated ones are spread over the slots;
    empty table: empty result.
    """
    spark = df.sparkSession
    rec = stored_records(df, id_col, text_col, slots)
    slot_map = balanced_map(slot_loads(rec, slots), shards)
    stored = store_map(spark, slot_map, map_path or scratch_path(spark, "slot-map"), 0)
    return place(rec, stored).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.lit(0).alias("map_version"))
