"""Fixed virtual slots: records hash into SLOTS slots for good; a versioned map sends slots to shards.

Only the map changes when data or shards change: bytes are summed per slot, and slots move from the fullest to the
emptiest shard until the shards are as even as slots allow. The map is a small file per version, which one run alone can
create; a run takes the latest version, edits it and stores the next. It has SLOTS rows whatever the input, so it is edited on the driver
and broadcast; records never pass through it.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalframe.llm.common import narrowed
from signalframe.scratch import claim, claimed, claims, shared_dir, written

SLOTS = 8192
SEED = 2024
LAW = "bytes"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 and the record's fixed virtual slot (a hash of doc_id and text).

    Rows of one doc_id, or of none, so spread by their texts. Records that repeat in all columns are alike: they are numbered
    and the hash takes the number in, so they spread from the second on, and more of them move none of the others. Numbers
    are counted per part of the table first, so no part of it is large.
    """
    rows = written(
        narrowed(docs).select(
            "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
            F.xxhash64(F.lit(SEED), "doc_id", "text").alias("hash"), F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part"),
        ),
        "shard-records",
    )
    parts = rows.groupBy("hash", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = parts.withColumn("before", F.sum("n").over(ahead)).where("before is not null").select("hash", "part", "before")
    own = F.row_number().over(Window.partitionBy("hash", "part").orderBy("place")) - 1
    number = F.col("own") + F.coalesce("before", F.lit(0))
    spread = F.when(number > 0, F.xxhash64("hash", number.cast("long"))).otherwise(F.col("hash"))
    return rows.withColumn("own", own).join(later, ["hash", "part"], "left").select("doc_id", "size", "text_crc32", F.pmod(spread, F.lit(slots)).cast("int").alias("vslot"))


def first_map(slots: int, shards: int) -> np.ndarray:
    return np.arange(slots) % shards


def rebalance(held: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """The next version of a slot-to-shard map: slots move, one at a time, from the fullest to the emptiest shard.

    A move takes the slot nearest to half the gap; if none lies within the gap, two slots are swapped instead. Stops
    when no move makes the pair more even. Shards that the old map lacks start empty.
    """
    held = held.copy()
    load = np.bincount(held, weights=weight, minlength=shards)
    while True:
        for low in np.argsort(load, kind="stable")[: shards // 2 + 1]:
            high = int(np.argmax(load))
            gap = load[high] - load[low]
            mine = np.flatnonzero(held == high)
            mine = mine[(weight[mine] > 0) & (weight[mine] < gap)]
            if not len(mine):
                theirs = np.flatnonzero(held == low)
                mine = np.flatnonzero(held == high)
                if not len(theirs) or not len(mine):
                    continue
                spread = weight[mine][:, None] - weight[theirs][None, :]
                at = np.unravel_index(np.argmin(np.abs(spread - gap / 2)), spread.shape)
                if not 0 < spread[at] < gap:
                    continue
                held[mine[at[0]]], held[theirs[at[1]]] = low, high
                moved = spread[at]
            else:
                best = mine[np.argmin(np.abs(weight[mine] - gap / 2))]
                held[best], moved = low, weight[best]
            load[high] -= moved
            load[low] += moved
            break
        else:
            return held


def stored_map(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, np.ndarray] | None:
    """(version, shard of each slot): the latest or the named version of the map in ``folder``; none there gives None."""
    names = claims(spark, folder)
    if not names:
        return None
    at = int(names[-1]) if version is None else version
    return at, np.array(json.loads(claim(spark, f"{folder}/{at:012d}")), np.int64)


def store_map(spark: SparkSession, folder: str, version: int, held: np.ndarray) -> bool:
    """Stores one version, a small file that only one writer can create; False if another run has stored that version."""
    return claimed(spark, f"{folder}/{version:012d}", json.dumps(held.tolist()))


def next_map(records: DataFrame, folder: str, shards: int, slots: int = SLOTS) -> tuple[int, DataFrame]:
    """Edits the latest stored version for these records and shards, stores the next and reads it back.

    Returns (its number, a row per slot: vslot, shard, before: the rows that stand ahead of the slot in its shard). A
    folder without a map first gets version 0, which deals slots round. A map that needs no edit keeps its version.
    """
    spark = records.sparkSession
    got = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # SLOTS rows at most
    weight, n = np.zeros(slots), np.zeros(slots, np.int64)
    for row in got:
        weight[row["vslot"]], n[row["vslot"]] = row["bytes"], row["n"]
    if stored_map(spark, folder) is None:
        store_map(spark, folder, 0, first_map(slots, shards))
    while True:  # again from the latest if another run stores a version meanwhile
        version, held = stored_map(spark, folder)
        if len(held) != slots or held.max() >= shards:
            raise ValueError(f"the stored map has {len(held)} slots over {held.max() + 1} shards; slots are fixed and shards only grow")
        edited = rebalance(held, weight, shards)
        if np.array_equal(edited, held):
            break
        if store_map(spark, folder, version + 1, edited):
            version, held = version + 1, edited
            break
    before, filled = np.zeros(slots, np.int64), np.zeros(shards, np.int64)
    for s, shard in enumerate(held):
        before[s] = filled[shard]
        filled[shard] += n[s]
    places = [(s, int(x), int(before[s])) for s, x in enumerate(held)]
    return version, spark.createDataFrame(places, "vslot int, shard int, before long")


def sharded(docs: DataFrame, shards: int = 24, folder: str | None = None) -> DataFrame:
    """Each document's shard under law ``bytes``, and its place there, gapless from 0.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), vslot, map_version. The map is
    kept in ``folder`` (a new one in the shared folder if not named): a later call with it, over grown tables or more
    shards, edits the latest version. Null and empty texts have size 8; null doc_ids are spread by their texts; repeated
    rows each have a place. Other columns are ignored. An empty table gives an empty result and leaves the map as it is.
    """
    records = written(slotted(docs), "slotted")
    version, places = next_map(records, folder or f"{shared_dir(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}", shards)
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("at", F.row_number().over(within))
        .join(F.broadcast(places), "vslot")  # SLOTS rows, always
        .select(
            "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"),
        )
    )
