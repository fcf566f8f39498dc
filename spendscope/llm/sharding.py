"""Sharding by longest-processing-time scheduling: groups that must stay together, sorted
by size, go to the least-loaded shard through a heap.

A group is all rows with one text. Groups of at least one part in ``GRAIN`` of a shard are
scheduled by themselves (there are at most ``shards * GRAIN`` of them). All smaller groups
are bound by a hash of their text to bundles, which are scheduled like groups. Bundles
come in ``_LEVELS`` halving sizes, so that the last ones are small enough to level the
loads. The heap on the driver thus holds a number of items that does not grow with the
input; a third of all rows in one group is one item.

Defined cases: a NULL text is grouped with empty ones and has size 1; a NULL id is numbered
before others; repeated rows are documents like others; an empty table gives no rows; equal
sizes are scheduled by their number; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm import frames

GRAIN = 256
_LEVELS = 12
_BUNDLES = 256


def schedule(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """A shard for each item: the largest first, each to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item in sorted(sizes, key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        out[item] = shard
        heapq.heappush(heap, (load + sizes[item], shard))
    return out


def _bundle() -> Column:
    """The bundle of a group: a level that half as many groups reach as the one before,
    and a number within it."""
    h = F.xxhash64("group")
    low = h.bitwiseOR(F.lit(1 << (_LEVELS - 1)))
    level = F.bit_count(low.bitwiseXOR(low - 1)) - 1
    return (level * _BUNDLES + F.shiftrightunsigned(h, 40) % _BUNDLES).cast("int")


def numbered(rows: DataFrame, group: str, order: list[str], slot: str) -> DataFrame:
    """Rows with a number within their ``group``, from 0 without gaps, by ``order``.

    The rows are range-sorted once and kept; a row's number is its place in its partition
    plus the group's rows in earlier partitions. That table has a row for each partition
    and group that meet, at most their sum.
    """
    ranged = frames.checkpointed(
        rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    met = ranged.groupBy(part, group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    met = met.select(F.col("_part").alias("_met"), F.col(group).alias("_group"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(met), (F.col("_part") == F.col("_met")) & F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(slot, F.col("_at") + F.col("_shift"))
        .select(*rows.columns, slot)
    )


def assigned(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``size`` (bytes of the text plus 1), ``text_crc32``, ``shard`` and ``slot``
    of every row; equal texts share a shard, and the shards' sizes are near equal."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = frames.checkpointed(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("group")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = (
        rows.groupBy("group").agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") * (shards * GRAIN) >= total).orderBy("group").collect()
    )
    spark = docs.sparkSession
    first = _LEVELS * _BUNDLES
    alone = spark.createDataFrame([(bytearray(r["group"]), first + i) for i, r in enumerate(large)], "_group binary, _item int")
    placed = (
        rows.join(F.broadcast(alone), F.col("group") == F.col("_group"), "left")
        .select("key", "size", "text_crc32", F.coalesce("_item", _bundle()).alias("item"))
    )
    sizes = {r["item"]: r["size"] for r in placed.groupBy("item").agg(F.sum("size").alias("size")).collect()}
    plan = spark.createDataFrame(sorted(schedule(sizes, shards).items()), "_of int, shard int")
    dealt = placed.join(F.broadcast(plan), F.col("item") == F.col("_of")).select("key", "size", "text_crc32", "shard")
    return numbered(dealt, "shard", ["key", "text_crc32"], "slot").withColumnRenamed("key", key)
