"""Top-k and row numbers over a whole result."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.plans.materialize import shared


def ascending(*columns: str) -> list[Column]:
    """Tie-break order: the key columns, NULL first."""
    return [F.asc_nulls_first(c) for c in columns]


def top_k(df: DataFrame, order: Sequence[Column], k: int, position: str = "position") -> DataFrame:
    """First ``k`` rows by ``order``, numbered. The sort keeps k rows per task; the
    window then sees at most k rows."""
    return numbered(df.orderBy(*order).limit(k), order, position)


def numbered(df: DataFrame, order: Sequence[Column], position: str = "position") -> DataFrame:
    """Row numbers over a frame with few rows (a limit, or one row per country or
    platform): the window runs in one task. For any other frame use ``global_rank``."""
    return df.withColumn(position, F.row_number().over(Window.orderBy(*order)))


def global_rank(
    df: DataFrame, order: Sequence[str], position: str = "position", kept: list[DataFrame] | None = None
) -> DataFrame:
    """Row numbers over a frame of any size, without moving it to one task.

    ``order`` names columns: ascending with NULL first, or descending with NULL last where the
    name begins with "-". It should end in a unique key, so that a heavy value still splits.
    The rows are range-partitioned and persisted: one shuffle. A row's number is its place in
    its partition plus the size of the partitions before; that offset table has one row per
    partition, so it is broadcast. The persisted rows are appended to ``kept``, for the caller
    to drop with its result; without it they stay until ``spark.catalog.clearCache()`` or the
    end of the session.
    """
    columns = [F.desc(name[1:]) if name.startswith("-") else F.asc_nulls_first(name) for name in order]
    ranges = shared(df.orderBy(*columns).withColumn("_id", F.monotonically_increasing_id()))
    if kept is not None:
        kept.append(ranges)
    part = F.shiftright("_id", 33)
    offsets = ranges.groupBy(part.alias("_part")).count().select(
        F.col("_part").alias("_range"),
        F.coalesce(
            F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
    )
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        ranges.join(F.broadcast(offsets), part == F.col("_range"))
        .withColumn(position, within + F.col("_offset"))
        .drop("_id", "_range", "_offset")
    )
