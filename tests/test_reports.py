"""Edge rows per report: NULLs, boundaries, fan-out, ties, empty input."""

import json
from datetime import timedelta

import pytest
from conftest import AS_OF, day, rows_of
from pyspark.sql import functions as F

from spendscope.operators import anomaly, campaign, creative, impression, regional, weekly


def sections_of(report):
    return {r["section"]: json.loads(r["summary_data"]) for r in report.collect()}


# ---------------------------------------------------------------- weekly


def test_weekly_base_filters_and_thresholds(facts):
    df = facts([
        dict(spend=500, conversions=5),
        dict(platform="Google", spend=499.99, conversions=50),
        dict(platform="Bing", spend=5000, conversions=4),
        dict(platform="tiktok", spend=5000, conversions=50),
        dict(country="NZ", spend=5000, conversions=50),
        dict(date=day(8), spend=5000, conversions=50),
        dict(spend=0, conversions=100),
        dict(date=day(-3), campaign_objective=None, campaign_id="c2", spend=900, conversions=9),
        dict(date=day(7), campaign_objective=None, campaign_id=None, spend=100, conversions=1),
    ])
    out = weekly.base(df, AS_OF)
    assert rows_of(out, "platform", "campaign_objective", "total_spend", "total_conversions", "campaign_count") == [
        ("Meta", None, 1000.0, 10, 1), ("Meta", "Traffic", 500.0, 5, 1)]


def test_weekly_campaigns_count_once_per_segment(facts):
    df = facts([dict(spend=600, campaign_objective=o) for o in ("Traffic", "Sales")])
    assert rows_of(weekly.platform_summary(weekly.base(df, AS_OF)), "platform", "total_campaigns") == [("Meta", 2)]


def test_empty_lists_match_nothing(facts):
    df = facts([dict(spend=600)])
    assert weekly.base(df, AS_OF, countries=[]).count() == 0
    assert weekly.base(df, AS_OF, platforms=[]).count() == 0


def test_weekly_rank_shares_ties_and_skips(facts):
    df = facts([dict(country=c, spend=s, conversions=10) for c, s in (("US", 600), ("AU", 600), ("UK", 700))])
    out = weekly.regional_overview(weekly.base(df, AS_OF))
    assert rows_of(out, "country", "efficiency_rank", "position") == [("AU", 1, 2), ("UK", 3, 1), ("US", 1, 3)]


def test_weekly_opportunity_without_objective_has_no_description(facts):
    df = facts([dict(campaign_objective=None, spend=1000, conversions=100)])
    out = weekly.scale_opportunities(weekly.base(df, AS_OF))
    assert rows_of(out, "description", "additional_spend_potential", "efficiency_margin") == [(None, 500, 80.0)]


def test_weekly_issue_boundary_is_exclusive(facts):
    df = facts([dict(spend=600, conversions=10), dict(country="AU", spend=600.1, conversions=10)])
    assert rows_of(weekly.top_issues(weekly.base(df, AS_OF)), "description") == [("Meta - AU",)]


def test_weekly_report_without_rows(facts):
    out = sections_of(weekly.report(facts([dict(spend=1)]), AS_OF))
    assert list(out) == ["PLATFORM_OVERVIEW", "REGIONAL_OVERVIEW", "SCALE_OPPORTUNITIES", "TOP_ISSUES"]
    assert out["PLATFORM_OVERVIEW"]["platform_performance"] is None
    assert out["TOP_ISSUES"] == {"performance_issues": None}


def test_weekly_is_unchanged_when_data_and_day_move_together(facts):
    rows = [dict(date=day(n), country=c, spend=90 + n, conversions=n + 1)
            for n in range(10) for c in ("US", "AU")]
    df = facts(rows)
    moved = df.withColumn("date", F.date_add("date", 17))
    assert rows_of(weekly.base(df, AS_OF)) == rows_of(weekly.base(moved, AS_OF + timedelta(days=17)))


def test_parameters_are_checked(facts):
    df = facts([{}])
    for call in (
        lambda: weekly.base(df, AS_OF, "8d"),
        lambda: weekly.base(df, AS_OF, platforms=["tiktok"]),
        lambda: creative.top_ads(creative.data(df, AS_OF), "ctr"),
        lambda: anomaly.features(df, AS_OF, "extreme"),
        lambda: regional.report(df, AS_OF, comparison_type="city"),
        lambda: weekly.base(df.drop("spend"), AS_OF),
    ):
        with pytest.raises(ValueError):
            call()


# ---------------------------------------------------------------- campaign


def test_campaign_fan_out(facts):
    df = facts([dict(country=c, spend=10, conversions=1) for c in ("US", "AU")]
               + [dict(country=c, spend=30, conversions=2, date=day(9)) for c in ("US", "AU")])
    perf = campaign.performance(df, AS_OF, ["grow"])
    assert rows_of(perf, "country", "spend_current", "cpa_current", "spend_comparison", "cpa_comparison",
                   "cpa_change_pct") == [
        ("AU", 20.0, 10.0, 120.0, 15.0, -33.3), ("US", 20.0, 10.0, 120.0, 15.0, -33.3)]
    assert rows_of(campaign.executive_summary(perf), "total_campaigns", "total_spend") == [(2, 40.0)]
    assert rows_of(campaign.comparison_period(df, AS_OF, ["grow"]), "spend_comparison") == [(120.0,)]


def test_campaign_totals_include_rows_that_do_not_match(facts):
    df = facts([
        dict(spend=10), dict(campaign="Other name", spend=5), dict(spend=0, clicks=950),
        dict(campaign_id=None, spend=99), dict(campaign_id="c2", date=day(10)),
    ])
    assert rows_of(campaign.matches(df, AS_OF, ["grow"]), "campaign_id") == [(None,), ("c1",), ("c2",)]
    out = campaign.current_period(df, AS_OF, ["grow"])
    # all rows of c1, also without spend or with another name; c2 has no current rows
    assert rows_of(out, "campaign_id", "spend_current", "ctr_current") == [("c1", 15.0, 35.0)]


def test_campaign_that_only_has_rows_without_spend_does_not_match(facts):
    df = facts([dict(spend=0), dict(campaign="Other", spend=10)])
    assert campaign.performance(df, AS_OF, ["grow"]).count() == 0
    assert campaign.performance(df, AS_OF, []).count() == 0


def brute_force_campaign(rows, terms, current, total):
    """The fan-out join, row by row."""
    def key(r):
        return r["campaign_id"], r["campaign"], r["platform"], r["country"]

    recent = [r for r in rows if r["date"] >= day(total)]
    matches = {key(r) for r in recent if r["spend"] > 0 and any(t in r["campaign"].lower() for t in terms)}
    out = {}
    for m in matches:
        own = [r for r in recent if r["campaign_id"] == m[0]]
        now = [r for r in own if r["date"] >= day(current)]
        times = sum(1 for x in matches if x[0] == m[0])
        before = [r for r in own if r["date"] < day(current)]
        if now:
            out[m] = (sum(r["spend"] for r in now), times * sum(r["spend"] for r in before) if before else None)
    return out


def test_campaign_against_brute_force(facts):
    rows = [
        dict(date=day(n % 16), campaign_id=f"c{n % 4}", campaign=("Grow", "Earn", "grow 2")[n % 3],
             platform=("Meta", "Google")[n % 2], country=("US", "AU", "UK")[n // 7 % 3], spend=n % 5,
             conversions=n % 3)
        for n in range(400)
    ]
    expected = brute_force_campaign(rows, ["grow"], 7, 14)
    perf = campaign.performance(facts(rows), AS_OF, ["GROW"])
    got = {(r["campaign_id"], r["campaign"], r["platform"], r["country"]):
           (float(r["spend_current"]), None if r["spend_comparison"] is None else float(r["spend_comparison"]))
           for r in perf.collect()}
    assert got == expected and len(got) > 20


def test_campaign_problems_and_performers(facts):
    df = facts([
        dict(campaign_id="bad", campaign="Grow " + "x" * 100, spend=700, conversions=10),
        dict(campaign_id="costly", spend=1100, conversions=20), dict(campaign_id="edge", spend=1000, conversions=20),
        dict(campaign_id="none", spend=50, conversions=0), dict(campaign_id="good", spend=200, conversions=10),
        dict(campaign_id="small", spend=199, conversions=10),
    ])
    perf = campaign.performance(df, AS_OF, ["grow"])
    problems = campaign.problems(perf)
    assert [r[0] for r in rows_of(problems, "campaign_id")] == ["bad", "costly", "none"]
    assert {len(r["campaign_name"]) for r in problems.collect()} == {105, 8}
    packed = sections_of(campaign.report(df, AS_OF, ["grow"]))["PROBLEM_CAMPAIGNS"]
    assert packed["part"] == 1
    assert {len(c["campaign_name"]) for c in packed["campaigns_needing_attention"]} == {80, 8}
    assert rows_of(problems.where("campaign_id = 'none'"), "comparison_cpa", "cpa_change_pct", "current_cpa") == [
        (0.0, 0.0, None)]
    assert rows_of(campaign.top_performers(perf), "spend") == [(200.0,)]


def test_campaign_creatives_count_once_per_match(facts):
    ads = [dict(country=c, ad_name=a, spend=30, conversions=1)
           for c in ("US", "AU") for a in ("Idea // v1", "Other", None)]
    df = facts(ads + [dict(platform="Google", ad_name="Idea // v1", spend=1000, conversions=9)])
    counts = campaign.match_counts(campaign.matches(df, AS_OF, ["grow"]))
    out = campaign.creatives(df, AS_OF, counts)
    # three matches (two countries on Meta, one on Google): 60 becomes 180
    assert rows_of(out, "position", "creative_concept", "spend", "conversions", "cpa") == [
        (1, "Idea", 180.0, 6, 30.0), (2, "Other", 180.0, 6, 30.0)]


def test_campaign_report_sections(facts):
    df = facts([dict(spend=600)])
    out = sections_of(campaign.report(df, AS_OF, ["grow"], include_creatives=True))
    assert list(out) == ["CREATIVE_ANALYSIS", "EXECUTIVE_SUMMARY", "PROBLEM_CAMPAIGNS", "TOP_PERFORMERS"]
    assert out["EXECUTIVE_SUMMARY"]["platform_breakdown"] == {"meta": 1, "google": 0, "tiktok": 0, "other": 0}
    out = sections_of(campaign.report(df, AS_OF, ["nothing like it"]))
    assert list(out) == ["EXECUTIVE_SUMMARY", "PROBLEM_CAMPAIGNS", "TOP_PERFORMERS"]
    assert out["EXECUTIVE_SUMMARY"]["total_campaigns"] == 0
    assert out["EXECUTIVE_SUMMARY"]["total_spend"] is None
    assert out["PROBLEM_CAMPAIGNS"]["campaigns_needing_attention"] is None


# ---------------------------------------------------------------- creative


def test_creative_thresholds_are_clamped_and_per_country(facts):
    df = facts([dict(spend=50, conversions=2), dict(country="AU", spend=49, conversions=2),
                dict(country="UK", spend=60, conversions=1)])
    assert rows_of(creative.data(df, AS_OF, min_spend=1), "country") == [("US",)]
    assert creative.effective_min_spend(1) == 50 and creative.effective_min_spend(10**6) == 10_000


def test_creative_concepts_average_rates_without_weights(facts):
    df = facts([dict(ad_id="a1", ad_name="Idea // x", spend=400, clicks=10, impressions=100),
                dict(ad_id="a2", ad_name="Idea // y", spend=400, clicks=30, impressions=1000)])
    concepts = creative.concept_summary(creative.data(df, AS_OF))
    assert rows_of(concepts, "creative_concept", "ad_count", "avg_ctr", "performance_tier") == [
        ("Idea", 2, 6.5, "GOOD")]


def test_creative_sort_keys(facts):
    df = facts([dict(ad_id="a1", spend=400, conversions=10), dict(ad_id="a2", spend=900, conversions=20),
                dict(ad_id="a3", spend=500, conversions=25)])
    ads = creative.data(df, AS_OF)

    def order(key):
        return [float(r["spend"]) for r in sorted(creative.top_ads(ads, key).collect(), key=lambda r: r["rank"])]

    assert order("cpa") == [500, 400, 900]
    assert order("spend") == [900, 500, 400]
    assert order("conversions") == [500, 900, 400]


def test_creative_report_without_rows(facts):
    out = sections_of(creative.report(facts([dict(platform="Google")]), AS_OF))
    assert out["CREATIVE_OVERVIEW"]["total_creatives_analyzed"] == 0
    assert out["CREATIVE_OVERVIEW"]["performance_distribution"] is None
    assert out["TOP_CONCEPTS"]["best_performing_concepts"] is None


# ---------------------------------------------------------------- regional


def test_regional_null_key_has_no_trend(facts):
    df = facts([dict(spend=600, date=day(n), campaign_objective=o, country=c)
                for n in (1, 20) for o in ("Traffic", None) for c in ("US", None)])
    out = regional.performance(df, AS_OF)
    assert rows_of(out, "country", "campaign_objective", "spend_previous", "cpa_change_pct") == [
        (None, None, None, None), (None, "Traffic", None, None), ("US", None, None, None),
        ("US", "Traffic", 600.0, 0.0)]


def test_regional_needs_current_rows(facts):
    df = facts([dict(spend=600, date=day(20)), dict(spend=700, country="AU"), dict(spend=499, country="UK")])
    out = regional.performance(df, AS_OF)
    assert rows_of(out, "country", "spend_previous") == [("AU", None)]


def test_regional_one_scan_equals_the_join_of_both_periods(facts):
    df = facts([
        dict(date=day(n % 31), platform=("Meta", "Google", "Bing")[n % 3], country=("US", "AU", None)[n // 3 % 3],
             campaign_objective=("Traffic", None)[n // 9 % 2], campaign_id=f"c{n % 5}", spend=n % 90,
             conversions=n % 4, clicks=n, impressions=10 * n)
        for n in range(600)
    ])
    now, before = regional.current(df, AS_OF), regional.previous(df, AS_OF)
    keys = ["platform", "country", "campaign_objective"]
    joined = now.join(before, keys, "left").where("spend_current >= 500")
    columns = [*joined.columns]
    assert rows_of(regional.performance(df, AS_OF).select(columns)) == rows_of(joined)
    assert joined.count() > 3


def test_regional_country_without_conversions_ranks_first(facts):
    df = facts([dict(country="US", spend=2000, conversions=100), dict(country="AU", spend=1500, conversions=0)])
    ranked = regional.country_ranked(regional.country_summary(regional.performance(df, AS_OF)))
    assert rows_of(ranked, "country", "blended_cpa", "efficiency_rank") == [("AU", None, 1), ("US", 20.0, 2)]
    (row,) = regional.insights(ranked).collect()
    assert row["best_performing_country"] == "AU" and row["highest_spend_country"] == "US"
    assert row["most_improved"] is None and row["needs_attention"] is None


def test_regional_insights(facts):
    df = facts(
        [dict(country="US", campaign_objective=o, spend=1000, conversions=c, date=day(d))
         for o in ("A", "B") for c, d in ((10, 1), (20, 20))]
        + [dict(country="AU", spend=1200, conversions=c, date=day(d)) for c, d in ((20, 1), (10, 20))])
    ranked = regional.country_ranked(regional.country_summary(regional.performance(df, AS_OF)))
    (row,) = regional.insights(ranked).collect()
    assert row.asDict() == {
        "best_performing_country": "AU", "highest_spend_country": "US", "most_improved": "AU",
        "needs_attention": ["US"], "total_countries_analyzed": 2}
    (row,) = regional.insights(ranked, include_trends=False).collect()
    assert row["most_improved"] == "Trend analysis disabled"


def test_regional_report_keeps_the_section_not_asked_for(facts):
    df = facts([dict(spend=1200)])
    out = sections_of(regional.report(df, AS_OF))
    assert out["PLATFORM_BY_COUNTRY"]["platform_country_matrix"] is None
    assert len(out["COUNTRY_COMPARISON"]["country_performance"]) == 1
    out = sections_of(regional.report(df, AS_OF, comparison_type="platform_by_country", include_trends=False))
    assert out["COUNTRY_COMPARISON"]["country_performance"] is None
    assert out["COUNTRY_COMPARISON"]["trend_analysis_included"] is False
    assert len(out["PLATFORM_BY_COUNTRY"]["platform_country_matrix"]) == 1


# ---------------------------------------------------------------- anomaly


def test_anomaly_fan_out(facts):
    df = facts([dict(campaign_objective=o, date=day(d), spend=2000, conversions=20)
                for o in ("A", "B") for d in (1, 10)])
    assert anomaly.features(df, AS_OF).count() == 4


def test_anomaly_without_comparison_or_with_null_country(facts):
    df = facts([dict(spend=2000, conversions=20), dict(spend=2000, date=day(10), campaign_id="other")])
    out = anomaly.features(df, AS_OF)
    assert rows_of(out, "cpa_change_pct", "spend_comparison", "excess_cost", "confidence_level") == [
        (None, None, 1000.0, "HIGH")]


@pytest.mark.parametrize("change, kind", [
    (dict(conversions=40), "CPA_SHIFT"),
    (dict(impressions=500), "CTR_SHIFT"),
    (dict(clicks=20, impressions=400), "CVR_SHIFT"),
    (dict(spend=2000, conversions=40, clicks=200, impressions=4000), "SPEND_SHIFT"),
])
def test_anomaly_types(facts, change, kind):
    before = dict(spend=1000, conversions=20, clicks=100, impressions=2000)
    df = facts([{**before, "date": day(10)}, {**before, **change}])
    found = anomaly.significant_campaigns(anomaly.features(df, AS_OF))
    assert rows_of(anomaly.campaign_section(found), "anomaly_type") == [(kind,)]


def test_anomaly_cost_overrun_and_quiet_campaign(facts):
    def both(**row):
        return [{**row, "date": day(10)}, row]

    df = facts(both(spend=1600, conversions=20) + both(campaign_id="quiet", spend=1000, conversions=20))
    features = anomaly.features(df, AS_OF)
    found = anomaly.significant_campaigns(features)
    assert rows_of(anomaly.campaign_section(found), "anomaly_type", "excess_cost") == [("COST_OVERRUN", 600.0)]
    (row,) = anomaly.summary(found, anomaly.significant_regions(anomaly.regional(features))).collect()
    assert row["total_campaign_anomalies"] == 1 and float(row["total_excess_cost"]) == 600.0


def test_anomaly_report_without_rows(facts):
    out = sections_of(anomaly.report(facts([dict(spend=5)]), AS_OF, "high", min_impact_threshold=1))
    assert out["ANOMALY_SUMMARY"]["change_threshold_pct"] == 15
    assert out["ANOMALY_SUMMARY"]["min_impact_threshold"] == 100
    assert out["ANOMALY_SUMMARY"]["total_campaign_anomalies"] == 0
    assert out["ANOMALY_SUMMARY"]["total_excess_cost"] is None
    assert out["CAMPAIGN_ANOMALIES"] == {"significant_campaign_changes": None}


# ---------------------------------------------------------------- impression share


def test_impression_weighted_share_counts_the_weight_of_missing_values(shares):
    df = shares([dict(budget_lost_impression_share_pct=None, market_size_impressions=100),
                 dict(budget_lost_impression_share_pct=50, market_size_impressions=100)])
    assert rows_of(impression.base(df, AS_OF), "weighted_budget_lost") == [(25.0,)]


@pytest.mark.parametrize("values, mode", [
    (["a", None, None], None), (["a", "b"], "a"), (["b", "b", "a", None], "b"), ([None], None),
    ([None, "a"], None),
])
def test_impression_mode_counts_nulls_and_breaks_ties_low(shares, values, mode):
    df = shares([dict(market_position=v, performance_diagnosis=v, date=day(n)) for n, v in enumerate(values)])
    assert rows_of(impression.base(df, AS_OF), "primary_market_position", "primary_diagnosis") == [(mode, mode)]


def test_impression_modes_are_independent(shares):
    pairs = [("a", "x"), ("a", "y"), ("b", "y"), ("c", "y"), ("a", "z")]
    df = shares([dict(market_position=p, performance_diagnosis=d) for p, d in pairs])
    assert rows_of(impression.base(df, AS_OF), "primary_market_position", "primary_diagnosis") == [("a", "y")]


def test_impression_modes_of_a_campaign_with_many_labels(shares):
    labels = [f"label {n}" for n in range(300)] + ["label 7", None, None, None]
    df = shares([dict(market_position=v, performance_diagnosis=v, date=day(n % 14)) for n, v in enumerate(labels)])
    assert rows_of(impression.base(df, AS_OF), "primary_market_position", "total_clicks") == [(None, 50 * 304)]


def test_impression_row_filters_and_brand(shares):
    df = shares([
        dict(is_brand_campaign=None), dict(is_brand_campaign=True, campaign="brand"),
        dict(campaign="thin", actual_impressions=1000), dict(campaign="free", spend=0),
        dict(campaign="unclicked", clicks=9), dict(campaign="cheap", spend=499), dict(campaign="old", date=day(15)),
    ])
    assert rows_of(impression.base(df, AS_OF), "campaign", "is_brand_campaign") == [
        ("Grow one", None), ("brand", True)]
    kept = impression.base(df, AS_OF, include_brand_campaigns=False, min_spend_threshold=0)
    assert rows_of(kept, "campaign") == [("Grow one",), ("cheap",)]


def test_impression_mixed_opportunity_and_missing_shares(shares):
    df = shares([
        dict(campaign="mixed", budget_lost_impression_share_pct=8, rank_lost_impression_share_pct=8),
        dict(campaign="none", budget_lost_impression_share_pct=None, rank_lost_impression_share_pct=None),
    ])
    out = impression.classified(impression.base(df, AS_OF))
    assert rows_of(out, "campaign", "opportunity_type", "opportunity_score", "total_lost_share",
                   "calculated_market_share") == [
        ("mixed", "MIXED_OPPORTUNITY", 62.8, 16.0, 20.0), ("none", "OPTIMIZED", 20.0, 0.0, 20.0)]


def test_impression_totals_are_those_of_the_campaigns_shown(shares):
    df = shares([dict(campaign=f"c{n:02}", budget_lost_impression_share_pct=10 + n) for n in range(14)])
    out = sections_of(impression.report(df, AS_OF))
    assert out["ANALYSIS_SUMMARY"]["total_campaigns"] == 10
    assert out["REGIONAL_INSIGHTS"]["regional_performance"][0]["campaign_count"] == 10
    scores = [c["opportunity_score"] for c in out["OVERVIEW_RESULTS"]["campaigns"]]
    assert scores == sorted(scores, reverse=True) and len(scores) == 10


def test_impression_budget_results_are_ordered_by_score(shares):
    df = shares([
        dict(campaign="rich", budget_lost_impression_share_pct=16, estimated_budget_needed_for_lost_impressions=900),
        dict(campaign="poor", budget_lost_impression_share_pct=40, estimated_budget_needed_for_lost_impressions=1),
        dict(campaign="idle", budget_lost_impression_share_pct=40, budget_utilization_pct=50),
    ])
    shown = impression.limited(impression.classified(impression.base(df, AS_OF)), "budget_opportunities")
    assert rows_of(shown, "analysis_rank", "campaign") == [(1, "rich"), (2, "poor")]
    assert rows_of(impression.results(shown), "position", "campaign_name") == [(1, "poor"), (2, "rich")]
    out = sections_of(impression.report(df, AS_OF, "budget_opportunities"))
    assert list(out) == ["ANALYSIS_SUMMARY", "BUDGET_OPPORTUNITIES_RESULTS"]


def test_impression_rank_agrees_with_the_limited_rows(shares):
    df = shares([dict(campaign=f"c{n:02}", rank_lost_impression_share_pct=n % 7 * 5) for n in range(40)])
    campaigns = impression.classified(impression.base(df, AS_OF))
    ranked = impression.ranked(campaigns).where("analysis_rank <= 10")
    assert rows_of(ranked, "analysis_rank", "campaign") == rows_of(
        impression.limited(campaigns), "analysis_rank", "campaign")


def test_impression_report_without_rows(shares):
    out = sections_of(impression.report(shares([dict(region="NZ")]), AS_OF, "regional_comparison"))
    assert out["ANALYSIS_SUMMARY"]["total_campaigns"] == 0
    assert out["REGIONAL_COMPARISON_RESULTS"]["campaigns"] is None
    assert out["REGIONAL_INSIGHTS"]["regional_performance"] is None
