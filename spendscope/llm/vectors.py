"""Vector columns: which rows take part, and vectors as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames


def usable(rows: DataFrame, vector: str, key: str, limit: float) -> DataFrame:
    """``key`` and ``vec`` (array of double, no negative zeros) of the rows whose vector has
    entries, each a number below ``limit`` in size, and the commonest length (of equally
    common ones the greatest)."""
    entry = F.expr(f"transform({frames.quoted(vector)}, c -> CAST(c AS DOUBLE) + 0D)")
    whole = rows.select(F.col(frames.quoted(key)).alias("key"), entry.alias("vec")).where(
        F.expr(f"size(vec) > 0 AND forall(vec, c -> c IS NOT NULL AND abs(c) < {limit!r}D)"))
    common = whole.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return whole.where(F.size("vec") == (common["n"] if common else 0))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    if not len(column):
        return np.empty((0, 0), dtype=dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)
