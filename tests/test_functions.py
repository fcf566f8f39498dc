import random
from datetime import date
from functools import reduce

import pytest
from conftest import AS_OF, day, rows_of
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.functions import kpi, periods, pivots, text
from spendscope.settings import SENSITIVITY
from spendscope.sources.schemas import BLENDED_SUMMARY, IMPRESSION_SHARE_REPORT, conform, require_columns


def evaluate(spark, schema, values, column):
    return [r[0] for r in spark.createDataFrame(values, schema).coalesce(1).select(column).collect()]


def test_ratios_are_null_for_zero_and_null_denominators(spark):
    values = [(10.0, 4), (10.0, 0), (10.0, None), (None, 4)]
    a, b = F.col("a"), F.col("b")
    assert evaluate(spark, "a double, b int", values, kpi.cpa(a, b)) == [2.5, None, None, None]
    assert evaluate(spark, "a double, b int", values, kpi.ctr(a, b)) == [250.0, None, None, None]
    assert evaluate(spark, "a double, b int", values, kpi.cvr(a, b)) == [250.0, None, None, None]


def test_rating_boundaries(spark):
    values = [(25.0,), (25.01,), (40.0,), (40.01,), (60.0,), (60.01,), (None,)]
    assert evaluate(spark, "c double", values, kpi.performance_rating(F.col("c"))) == [
        "EXCELLENT", "GOOD", "GOOD", "ACCEPTABLE", "ACCEPTABLE", "NEEDS_ATTENTION", "NEEDS_ATTENTION"]


def test_target_status_boundaries(spark):
    values = [(20.0,), (20.01,), (25.0,), (25.01,), (30.0,), (30.01,), (None,)]
    assert evaluate(spark, "c double", values, kpi.target_status(F.col("c"), F.lit(25.0))) == [
        "EXCELLENT", "ON_TARGET", "ON_TARGET", "ACCEPTABLE", "ACCEPTABLE", "NEEDS_ATTENTION",
        "NEEDS_ATTENTION"]


def test_target_cpa_of_reports_and_of_the_whole_table(spark):
    values = [("Meta",), ("Google",), ("Bing",), ("TikTok",), ("other",), (None,)]
    p = F.col("p")
    assert evaluate(spark, "p string", values, kpi.target_cpa(p)) == [50.0, 25.0, 25.0, 40.0, 40.0, 40.0]
    assert evaluate(spark, "p string", values, kpi.target_cpa(p, platforms=None)) == [
        50.0, 25.0, 25.0, 50.0, 40.0, 40.0]


def test_changes_need_a_previous_value_above_zero(spark):
    values = [(12.0, 8.0), (8.0, 12.0), (1.0, 0.0), (1.0, None), (None, 1.0), (1.0, -1.0)]
    c, p = F.col("c"), F.col("p")
    got = evaluate(spark, "c double, p double", values, kpi.pct_change(c, p))
    assert [None if x is None else float(x) for x in got] == [50.0, -33.3, None, None, None, None]
    assert evaluate(spark, "c double, p double", values, kpi.fractional_change(c, p))[:1] == [0.5]
    got = evaluate(spark, "c double, p double", values, kpi.impression_share_change(c, p))
    assert [None if x is None else float(x) for x in got] == [50.0, -33.3, None, None, None, None]


def test_rounding_is_half_up_in_decimal(spark):
    values = [(6.175,), (1.005,), (-2.5,), (12345678.905,)]
    got = evaluate(spark, "x double", values, kpi.rounded(F.col("x"), 2))
    assert [str(x) for x in got] == ["6.18", "1.01", "-2.50", "12345678.91"]


def test_scale_potential_steps(spark):
    values = [(499.99,), (500.0,), (1499.99,), (1500.0,)]
    got = evaluate(spark, "s decimal(18,2)", [(__import__("decimal").Decimal(str(v[0])),) for v in values],
                   kpi.scale_potential(F.col("s")))
    assert [float(x) for x in got] == [499.99, 250.0, 749.995, 300.0]


def test_confidence_needs_spend_and_conversions(spark):
    values = [(2000, 15), (2000, 14), (1000, 10), (1000, 9), (500, 5), (499, 5), (500, 4)]
    got = evaluate(spark, "s int, c int", values,
                   kpi.confidence_level(F.col("s"), F.col("c"), SENSITIVITY["medium"]))
    assert got == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "INSUFFICIENT", "INSUFFICIENT"]


def test_excess_cost_is_spend_over_target(spark):
    values = [(1000, 10), (400, 10), (500, 10), (500, 0), (500, None)]
    got = evaluate(spark, "s int, c int", values,
                   kpi.excess_cost(F.col("s"), F.col("c"), F.lit(50.0)))
    assert [float(x) for x in got] == [500.0, 0.0, 0.0, 0.0, 0.0]


def test_opportunity_type_order(spark):
    values = [(30, 0), (0, 30), (15, 0), (0, 15), (8, 8), (7, 7), (None, None), (29, 30)]
    assert evaluate(spark, "b int, r int", values, kpi.opportunity_type(F.col("b"), F.col("r"))) == [
        "BUDGET_OPPORTUNITY", "RANK_OPPORTUNITY", "BUDGET_CONSTRAINED", "RANK_IMPROVEMENT",
        "MIXED_OPPORTUNITY", "OPTIMIZED", "OPTIMIZED", "RANK_OPPORTUNITY"]


def test_budget_status_boundaries(spark):
    values = [(85.0,), (84.99,), (60.01,), (60.0,), (None,)]
    assert evaluate(spark, "u double", values, kpi.budget_status(F.col("u"))) == [
        "CONSTRAINED", "BALANCED", "BALANCED", "UNDERUTILIZED", "BALANCED"]


def test_market_opportunity_score_bands(spark):
    values = [(50.0, 0.0, 200000), (49.9, 0.0, 0), (30.0, 0.0, 0), (15.0, 0.0, 0), (10.0, 0.0, 0),
              (None, None, None), (60.0, 0.0, 5000000)]
    got = evaluate(spark, "b double, r double, m long", values,
                   kpi.market_opportunity_score(F.col("b"), F.col("r"), F.col("m")))
    assert got == pytest.approx([92.0, 94.95, 85.0, 62.0, 35.0, 20.0, 140.0])


def test_windows(spark):
    days = spark.createDataFrame([(day(n),) for n in (-1, 0, 7, 8, 14, 15)], "date date")
    current = days.where(periods.current(AS_OF, 7))
    before = days.where(periods.comparison(AS_OF, 7, 14))
    assert [r[0] for r in rows_of(current)] == sorted([day(-1), day(0), day(7)])
    assert [r[0] for r in rows_of(before)] == sorted([day(8), day(14)])


def test_weeks_start_on_sunday(spark):
    values = [(date(2024, 1, 28),), (date(2024, 1, 30),), (date(2024, 2, 3),)]
    assert evaluate(spark, "d date", values, periods.week_start(F.col("d"))) == [date(2024, 1, 28)] * 3


def test_unknown_period_names_are_refused():
    for call in (lambda: periods.range_days("8d"), lambda: periods.period_days("yearly")):
        with pytest.raises(ValueError):
            call()


def test_contains_any_is_literal_and_case_insensitive(spark):
    names = spark.createDataFrame([("Grow_Campaign",), ("GrowXCampaign",), ("Earn 50%",), ("50x",), (None,)], "n string")

    def hits(terms):
        return [r[0] for r in rows_of(names.where(text.contains_any(F.col("n"), terms)))]

    assert hits(["grow_c"]) == ["Grow_Campaign"]
    assert hits(["50%"]) == ["Earn 50%"]
    assert hits(["xgrow"]) == []
    assert hits([]) == []
    assert hits([" GROW_ ", "50%"]) == ["Earn 50%", "Grow_Campaign"]
    assert hits([*[f"none {i}" for i in range(1000)], "50x"]) == ["50x"]


def test_dictionary_of_terms_equals_contains_any(spark):
    rng = random.Random(7)
    alphabet = "aAbB %_é1İΣς"
    made = ["".join(rng.choices(alphabet, k=rng.randrange(0, 40))) for _ in range(400)]
    names = spark.createDataFrame([(n,) for n in [*made, *made[:50], None, "", "a" * 3000]], "name string")
    for k in (1, 3, 40, 1500):
        terms = ["".join(rng.choices(alphabet, k=rng.randrange(1, 9))).strip() or "a" for _ in range(k)] + ["a" * 500, "x" * 70]
        found = text.names_with_any(names, "name", terms)
        plain = [names.where(text.contains_any(F.col("name"), terms[i:i + 200])) for i in range(0, len(terms), 200)]
        assert rows_of(found) == rows_of(reduce(DataFrame.union, plain).distinct()), k
    assert found.columns == ["name"]
    assert text.names_with_any(names, "name", []).count() == 0
    assert text.names_with_any(names, "name", ["a", " "]).count() == names.where("name IS NOT NULL").distinct().count()
    assert text.names_with_any(names.where("false"), "name", ["a"]).count() == 0


def test_a_name_is_compared_with_few_terms(spark):
    """Terms of one beginning, or of one end, are told apart by their other side."""
    values = spark.createDataFrame([(f"shop {i} sale",) for i in range(300)], "value string")
    for terms in ([f"shop {i:04}" for i in range(1000)], [f"{i:04} sale" for i in range(1000)]):
        assert text.term_candidates(values, terms).count() <= 2 * 300
    terms = [f"shop {i}" for i in range(1000)]
    assert text.names_with_any(values, "value", terms).count() == 300


def test_creative_name_parts(spark):
    names = [(None,), ("A",), ("A // b",), ("A // b // c",), ("A // b // c // d",), (" // b",),
             (" A\t // b",), ("x" * 60,), ("A//b",)]
    n = F.col("n")
    concept = evaluate(spark, "n string", names, text.creative_concept(n))
    assert concept == ["Unknown_Concept", "A", "A", "A", "A", "", "A", "x" * 50, "A//b"]
    formats = evaluate(spark, "n string", names, text.creative_format(n))
    assert formats == [None, None, None, "c", "c", None, None, None, None]
    creators = evaluate(spark, "n string", names, text.creative_creator(n))
    assert creators == [None, None, None, None, "d", None, None, None, None]


def test_pivots(facts):
    df = facts([
        dict(platform="Meta", spend=10.005, conversions=2), dict(platform="Meta", spend=20, conversions=0),
        dict(platform="Tik-Tok", spend=7, conversions=0),
    ])
    out = df.groupBy("country").agg(
        *pivots.platform_pivot("spend", ["Meta", "Tik-Tok", "Bing"]), *pivots.platform_cpa_pivot(["Meta", "Tik-Tok"]))
    assert out.columns == ["country", "meta_spend", "tik_tok_spend", "bing_spend", "meta_cpa", "tik_tok_cpa"]
    assert rows_of(out) == [("US", 30.01, 7.0, None, 15.01, None)]


def test_schemas_have_all_columns(spark):
    assert len(BLENDED_SUMMARY) == 27 and len(IMPRESSION_SHARE_REPORT) == 39
    df = conform(spark.createDataFrame([(1,)], "clicks int"), BLENDED_SUMMARY)
    # the type a column has is kept, further columns come last
    assert df.columns == BLENDED_SUMMARY.names and dict(df.dtypes)["clicks"] == "int"
    other = conform(spark.createDataFrame([("x", 1)], "note string, clicks int"), BLENDED_SUMMARY)
    assert other.columns == [*BLENDED_SUMMARY.names, "note"]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="spend, platform"):
        require_columns(spark.range(1), ["id", "spend", "platform"])
