"""Connected components by alternating stars, as joins and aggregates of links.

A large star links each node's larger neighbours to its smallest one, a small star does
the same with its smaller neighbours; when neither changes a link, every node is linked
to the smallest of its component. Each round is cut by a checkpoint. Nothing but a
count and a checksum of the links comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the
    links ``u``, ``v`` except the roots. Self-links, repeated and reversed links are allowed."""
    links = frames.checkpointed(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = _state(links)
    while before[0]:
        links = frames.checkpointed(_small(_large(links)))
        now = _state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
