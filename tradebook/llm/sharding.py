"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are taken by size, largest first, and each enters the bin whose remaining capacity is the
tightest that still holds it; the bins' remaining capacities stand in a balanced tree. To do this
at any scale, groups are dealt into lots of bounded size and each lot is packed in one task into bundles of
a capacity that is a small part of a shard. Only the bundles, a bounded number, are then packed
into the shards, again best fit decreasing, with the smallest capacity that needs no more shards
than asked for.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.llm.book import register, table
from tradebook.llm.common import numbered
from tradebook.session import pinned

GROUPS_PER_LOT = 100_000
BUNDLES_PER_SHARD = 256
SHARDS = 16


class Tree:
    """A balanced tree of depth two over (remaining capacity, bin): leaves of at most ``LEAF`` keys.

    A full leaf splits in halves and an empty one goes, so search, insertion and removal stay cheap
    for the number of bins one task or the driver holds.
    """

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.highest: list[tuple[int, int]] = []

    def add(self, key: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.highest = [[key]], [key]
            return
        at = min(bisect_left(self.highest, key), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, key)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at:at + 1] = [leaf[:half], leaf[half:]]
            self.highest[at:at + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.highest[at] = leaf[-1]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest key whose capacity is at least ``size``."""
        at = bisect_left(self.highest, (size, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        key = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.highest[at] = leaf[-1]
        else:
            del self.leaves[at], self.highest[at]
        return key


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size; ``sizes`` must fall. A size over the capacity gets a bin of its own.

    None as soon as more than ``most`` bins are needed.
    """
    tree, bins, out = Tree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if bins == most:
                return None
            found, bins = (max(capacity, size), bins), bins + 1
        out.append(found[1])
        tree.add((found[0] - size, found[1]))
    return out


def balanced(sizes: list[int], shards: int) -> list[int]:
    """Bins for falling ``sizes``: at most ``shards``, the fullest as small as a search over capacities finds.

    What is larger than an equal share of the rest gets a shard alone; the rest is packed with
    falling capacities as long as it still fits.
    """
    alone, left = 0, sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], shards - alone
    low = max([-(-left // bins), *rest[:1]])
    high, best = low, best_fit(rest, low, bins)
    while best is None:
        high = high + max(1, high // 64)
        best = best_fit(rest, high, bins)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(rest, middle, bins)
        if tried is None:
            low = middle + 1
        else:
            high, best = middle, tried
    return [*range(alone), *(alone + b for b in best)]


def packed_lots(groups: DataFrame, capacity: int, lots: int) -> DataFrame:
    """``groups`` (key, bytes) with the bundle each enters: (key, bytes, lot, bundle).

    Every lot is one hash part of the groups; bundles hold at most ``capacity``, or a single larger group.
    """
    def pack(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["bytes", "key"], ascending=[False, True])
        return lot.assign(bundle=best_fit(lot["bytes"].tolist(), capacity))

    schema = T.StructType([*groups.schema.fields, T.StructField("lot", T.LongType()), T.StructField("bundle", T.LongType())])
    return groups.withColumn("lot", F.pmod(F.xxhash64("key"), F.lit(lots))).groupBy("lot").applyInPandas(pack, schema)


def shard_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal indivisible ``groups`` (key, bytes) into ``shards`` shards of near equal size: (key, shard).

    Keys must be unique and not null. The driver packs the bundles of all lots: about
    ``BUNDLES_PER_SHARD`` a shard and at least one for every ``GROUPS_PER_LOT`` groups.
    An empty table gives an empty one; fewer groups than shards leave shards empty.
    """
    spark = groups.sparkSession
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    lots = max(1, -(-count // GROUPS_PER_LOT))
    capacity = max(1, total // (shards * BUNDLES_PER_SHARD))
    bundled = pinned(packed_lots(groups, capacity, lots))
    bundles = (
        bundled.groupBy("lot", "bundle").agg(F.sum("bytes").alias("bytes")).toPandas()
        .sort_values(["bytes", "lot", "bundle"], ascending=[False, True, True], ignore_index=True)
    )
    bundles["shard"] = pd.Series(balanced(bundles["bytes"].tolist(), shards), dtype="int32")
    where = spark.createDataFrame(bundles[["lot", "bundle", "shard"]], "lot long, bundle long, shard int")
    return bundled.join(F.broadcast(where), ["lot", "bundle"]).select("key", "shard")


def capacity_shards(groups: DataFrame, capacity: int, fill: int = 64) -> DataFrame:
    """Pack ``groups`` (key, bytes) into as few shards of at most ``capacity`` as best fit finds:
    (key, shard), shard an id of (lot, bin). Lots hold at least ``fill`` shards' worth, so that a
    lot's last open shard weighs little; a group over the capacity is a shard of its own."""
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    lots = max(1, min(-(-count // GROUPS_PER_LOT), total // (capacity * fill)))
    return packed_lots(groups, capacity, lots).select("key", (F.col("lot") * (1 << 32) + F.col("bundle")).alias("shard"))


def shard_rows(df: DataFrame, key: Column, size: Column, order: list[Column], shards: int = SHARDS) -> DataFrame:
    """``df`` plus size long, shard int and slot long (gapless from 0 in its shard).

    Rows of equal ``key`` share a shard; sums of sizes over shards are near equal, as far as groups
    allow. ``key`` must not be null; ``df`` should carry narrow rows, it is shuffled twice.
    Ties and repeated rows each get a slot of their own.
    """
    rows = df.select("*", size.cast("long").alias("size"), key.alias("_key"))
    groups = rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("bytes"))
    placed = shard_groups(groups, shards)
    joined = rows.join(placed, rows["_key"] == placed["key"]).select(*df.columns, "size", "shard")
    return numbered(pinned(joined), ["shard"], order, "slot")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard by law ``bytes``; null and empty texts are one group."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pinned(table(spark, sf_dir, "documents").select(
        "doc_id",
        F.unhex(F.sha2(text, 256)).alias("digest"),
        (F.octet_length(text) + 1).cast("long").alias("n"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ))
    out = shard_rows(rows, F.col("digest"), F.col("n"), [F.col("doc_id"), F.col("digest")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


register("op2_sharding", op2_sharding)
