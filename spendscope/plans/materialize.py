"""Computing a small aggregate once that several report sections share.

A report derives three or four sections from one aggregate of the fact table. As
one lazy plan each section would prune different columns of that aggregate, the
shuffles would no longer be equal, and the fact table would be scanned once per
section. Instead the aggregate is persisted when the report first runs: one scan,
and what an executor loses is computed again from its lineage. Nothing runs while
the plan is built, and no folder is needed.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame


def shared(df: DataFrame) -> DataFrame:
    """``df``, computed once by whatever runs first on it."""
    return df.persist()


def released_with(result: DataFrame, *parts: DataFrame) -> DataFrame:
    """``result``; its shared ``parts`` are dropped from memory and disk when Python lets
    go of it. A frame derived from it still gives the same rows, with more scans."""
    for part in parts:
        weakref.finalize(result, _drop, part).atexit = False
    return result


def _drop(part: DataFrame) -> None:
    if part.sparkSession.sparkContext._jsc is not None:
        part.unpersist()
