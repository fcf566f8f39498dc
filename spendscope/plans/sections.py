"""Packing typed section frames into ``(section, summary_data)`` rows of JSON."""

from __future__ import annotations

from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.functions import text

_WITH_NULLS = {"ignoreNullFields": "false"}

# items of an open-ended section in one row; a row stays at a few MB
ITEMS_PER_ROW = 10_000


def constant(value: Any) -> Column:
    """A header value: number, text, flag, list of text, or a Column as it is."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast("array<string>")
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return F.lit(value)


def json_object(fields: Mapping[str, Any]) -> Column:
    """JSON text of named values; NULL fields are kept."""
    return F.to_json(json_struct(fields), _WITH_NULLS)


def json_struct(fields: Mapping[str, Any]) -> Column:
    return F.struct(*[constant(value).alias(name) for name, value in fields.items()])


def section(name: str, summary: Column) -> list[Column]:
    return [F.lit(name).alias("section"), summary.alias("summary_data")]


def ordered_items(rows: DataFrame, position: str, columns: Sequence[str] | None = None) -> Column:
    """Aggregate: the rows as an array of structs by ``position``; NULL for no rows."""
    item = F.struct(*(columns or [c for c in rows.columns if c != position]))
    items = F.sort_array(F.collect_list(F.struct(F.col(position), item.alias("item"))))
    return F.when(F.size(items) > 0, F.transform(items, lambda x: x["item"]))


def pack(
    name: str,
    array: str,
    rows: DataFrame,
    header: Mapping[str, Any] | None = None,
    position: str = "position",
) -> DataFrame:
    """One row for a section whose size is bounded (a top-k, or one item per platform).
    Without rows the section is still there, with a NULL array."""
    return rows.agg(
        json_object({**(header or {}), array: ordered_items(rows, position)}).alias("summary_data")
    ).select(*section(name, F.col("summary_data")))


def pack_parts(
    name: str,
    array: str,
    rows: DataFrame,
    header: Mapping[str, Any] | None = None,
    items_per_row: int = ITEMS_PER_ROW,
    position: str = "position",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A section that may hold any number of items, as rows numbered by ``part`` from 1.

    No task could hold an open-ended array, so every ``items_per_row`` items, in order of
    their ``position`` (a ``global_rank``), make a row of the section. Without items the
    section is still there: part 1 with a NULL array.
    """
    parts = (
        rows.withColumn("part", F.expr(f"({position} - 1) div {items_per_row} + 1"))
        .groupBy("part")
        .agg(ordered_items(rows, position, columns).alias("items"))
    )
    first = rows.sparkSession.range(1, 2).select(F.col("id").alias("part"))
    fields = {**(header or {}), "part": F.col("part"), array: F.col("items")}
    return first.join(parts, "part", "full").select(*section(name, json_object(fields)))


def cut(rows: DataFrame, **lengths: int) -> DataFrame:
    """Long names shortened for the JSON; typed frames hold them whole."""
    return rows.withColumns({c: text.shortened(F.col(c), n) for c, n in lengths.items()})


def report(sections: Sequence[DataFrame]) -> DataFrame:
    """All sections in order of their name, a section's parts in order of their number."""
    part = F.get_json_object("summary_data", "$.part").cast("long")
    return reduce(DataFrame.unionByName, sections).orderBy("section", F.asc_nulls_first(part))
