"""Mergeable summaries kept in a column: counts of frequent labels, and distinct counts.

Both are states of a bounded size that a table can hold and that merge to any coarser key,
so a roll-up of them needs no second look at the facts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: labels a state tracks (with as many different labels or fewer, counts are exact), and the
#: logarithm of the registers of a distinct count (a relative error of 0.8 %)
TRACKED = 1024
PRECISION = 14


def label_counts(label: Column, tracked: int = TRACKED) -> Column:
    """Aggregate: the state of a column's labels; NULL is a label like others."""
    return F.call_function("approx_top_k_accumulate", label, F.lit(tracked))


def merged_label_counts(state: Column, tracked: int = TRACKED) -> Column:
    """Aggregate: the state of all rows that went into the states."""
    return F.call_function("approx_top_k_combine", state, F.lit(tracked))


def leading_label(state: Column, tracked: int = TRACKED) -> Column:
    """The most frequent label and its count (at most the true one plus the error of the
    sketch), as a struct. Of equally frequent ones NULL, then the lowest. The struct is NULL
    where there are no rows, or where more labels than are tracked leave none that surely
    stands out."""
    found = F.call_function("approx_top_k_estimate", state, F.lit(tracked))
    first = F.array_min(F.transform(found, lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("label"))))
    return F.when(first.isNotNull(), F.struct(first["label"].alias("label"), (-first["less"]).alias("count")))


def distinct_sketch(value: Column, precision: int = PRECISION) -> Column:
    """Aggregate: the state of a column's different values; NULL is none."""
    return F.hll_sketch_agg(value, F.lit(precision))


def merged_distinct(sketch: Column) -> Column:
    """Aggregate: the state of all rows that went into the states."""
    return F.hll_union_agg(sketch)


def distinct_estimate(sketch: Column) -> Column:
    """The number of different values. Exact up to a few hundred."""
    return F.hll_sketch_estimate(sketch)
