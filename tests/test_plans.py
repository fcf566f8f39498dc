"""Ranking, packing and shared aggregates."""

import gc
import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from spendscope.plans import params, ranking, sections
from spendscope.plans.materialize import released_with, shared


def test_global_rank_equals_a_sort_even_when_a_third_of_rows_tie(spark):
    df = spark.range(0, 30_000, numPartitions=7).select(
        "id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).cast("int").alias("v"))
    out = ranking.global_rank(df, ["-v", "id"], "rank").collect()
    expected = sorted(((r["id"], r["v"]) for r in out), key=lambda t: (-t[1], t[0]))
    assert [(r["id"], r["v"]) for r in sorted(out, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in out) == list(range(1, 30_001))


def test_global_rank_of_nothing(spark):
    assert ranking.global_rank(spark.range(0), ["id"]).count() == 0


def test_top_k_numbers_in_order(spark):
    out = ranking.top_k(spark.range(100), [F.desc("id")], 3)
    assert rows_of(out, "position", "id") == [(1, 99), (2, 98), (3, 97)]


def test_pack_orders_items_keeps_nulls_and_survives_no_rows(spark):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 1)], "position int, k string, v int")
    packed = sections.pack("S", "items", rows, {"n": 5.0, "names": ["x"], "none": []})
    (row,) = packed.collect()
    assert row["section"] == "S"
    assert row["summary_data"] == (
        '{"n":5,"names":["x"],"none":[],"items":[{"k":"a","v":1},{"k":"b","v":null}]}')
    (row,) = sections.pack("S", "items", rows.where("false")).collect()
    assert row["summary_data"] == '{"items":null}'


@pytest.mark.parametrize("per_row", [10_000, 10, 25, 7])
def test_section_in_parts_holds_every_item_in_order(spark, per_row):
    rows = spark.range(25).withColumn("double", F.col("id") * 2)
    ranked = ranking.global_rank(rows, ["-id"])
    packed = sections.pack_parts("S", "items", ranked, {"n": 1}, per_row, columns=["id"]).collect()
    parts = sorted((json.loads(r["summary_data"]) for r in packed), key=lambda p: p["part"])
    assert [p["part"] for p in parts] == list(range(1, -(-25 // per_row) + 1))
    assert [i["id"] for p in parts for i in p["items"]] == list(range(24, -1, -1))
    assert all(list(p) == ["n", "part", "items"] and list(p["items"][0]) == ["id"] for p in parts)
    assert all(len(p["items"]) <= per_row for p in parts)


def test_section_in_parts_without_rows(spark):
    (row,) = sections.pack_parts("S", "items", ranking.global_rank(spark.range(0), ["id"])).collect()
    assert row["summary_data"] == '{"part":1,"items":null}'


def test_report_is_ordered_by_section(spark):
    def one(name):
        return spark.range(1).select(F.lit(name).alias("section"), F.lit("{}").alias("summary_data"))

    assert [r["section"] for r in sections.report([one("C"), one("A"), one("B")]).collect()] == ["A", "B", "C"]


def test_shared_rows_go_with_the_result(spark):
    part = shared(spark.range(10).where("id > 3"))
    result = released_with(part.groupBy().count(), part)
    derived = result.where("count > 0")
    assert part.storageLevel.useMemory and result.collect()[0][0] == 6
    del result
    gc.collect()
    assert not part.storageLevel.useMemory
    assert derived.collect()[0][0] == 6


def test_parameters():
    assert params.clamped(5, 10, 20) == 10 and params.clamped(25, 10, 20) == 20
    assert params.platforms([" Meta "]) == ["Meta"]
    with pytest.raises(ValueError):
        params.platforms(["MySpace"])
    with pytest.raises(TypeError):
        params.names("US", "countries")
