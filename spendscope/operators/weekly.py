"""Weekly performance report: platforms and countries against target CPA."""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.functions import kpi, periods, sketches, text
from spendscope.plans import params, sections
from spendscope.plans.materialize import released_with, shared
from spendscope.plans.ranking import ascending, numbered, top_k
from spendscope.settings import DEFAULT_COUNTRIES, REPORT_PLATFORMS, SETTINGS, Settings
from spendscope.sources.schemas import require_columns

_COLUMNS = ["date", "platform", "country", "campaign_objective", "campaign_id", "spend", "conversions"]
_SEGMENT = ["platform", "country", "campaign_objective"]


def base(
    facts: DataFrame,
    as_of: date,
    date_range: str = "7d",
    platforms: Sequence[str] = REPORT_PLATFORMS,
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    settings: Settings = SETTINGS,
    with_sketches: bool = False,
) -> DataFrame:
    """Segments (platform, country, objective) with enough spend and conversions.

    With ``with_sketches`` each has a ``campaign_sketch``, and what is rolled up from them
    gains ``distinct_campaigns``: campaigns active in several segments count once.
    """
    more = [sketches.distinct_sketch(F.col("campaign_id")).alias("campaign_sketch")] if with_sketches else []
    return (
        require_columns(facts, _COLUMNS)
        .where(periods.current(as_of, periods.range_days(date_range)))
        .where(text.in_list(F.col("platform"), params.platforms(platforms)))
        .where(text.in_list(F.col("country"), params.names(countries, "countries")))
        .where(F.col("spend") > 0)
        .groupBy(*_SEGMENT)
        .agg(
            F.sum("spend").alias("total_spend"),
            F.sum("conversions").alias("total_conversions"),
            kpi.cpa(F.sum("spend"), F.sum("conversions")).alias("blended_cpa"),
            F.countDistinct("campaign_id").alias("campaign_count"),
            *more,
        )
        .where(F.col("total_spend") >= settings.weekly_min_spend)
        .where(F.col("total_conversions") >= settings.weekly_min_conversions)
    )


def _distinct_campaigns(segments: DataFrame) -> list[Column]:
    if "campaign_sketch" not in segments.columns:
        return []
    merged = sketches.merged_distinct(F.col("campaign_sketch"))
    return [sketches.distinct_estimate(merged).alias("distinct_campaigns")]


def platform_summary(segments: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Segments rolled up to platform. A campaign active in several segments counts
    once in each of them."""
    return (
        segments.groupBy("platform")
        .agg(
            F.sum("total_spend").alias("platform_spend"),
            F.sum("total_conversions").alias("platform_conversions"),
            kpi.cpa(F.sum("total_spend"), F.sum("total_conversions")).alias("platform_cpa"),
            F.sum("campaign_count").alias("total_campaigns"),
            *_distinct_campaigns(segments),
        )
        .withColumn("target_cpa", kpi.target_cpa(F.col("platform"), settings))
    )


def platform_overview(segments: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    cpa, target = F.col("platform_cpa"), F.col("target_cpa")
    summary = platform_summary(segments, settings)
    return numbered(summary, [F.asc_nulls_first("platform")]).select(
        "position",
        "platform",
        kpi.rounded(F.col("platform_spend"), 2).alias("spend"),
        F.col("platform_conversions").alias("conversions"),
        kpi.rounded(cpa, 2).alias("cpa"),
        target,
        kpi.rounded((cpa - target) / target * 100, 1).alias("vs_target_pct"),
        F.col("total_campaigns").alias("campaigns"),
        kpi.target_status(cpa, target, settings).alias("status"),
    )


def regional_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("country").agg(
        F.sum("total_spend").alias("country_spend"),
        F.sum("total_conversions").alias("country_conversions"),
        kpi.cpa(F.sum("total_spend"), F.sum("total_conversions")).alias("country_cpa"),
        F.countDistinct("platform").alias("active_platforms"),
        *_distinct_campaigns(segments),
    )


def regional_overview(segments: DataFrame) -> DataFrame:
    """One row per requested country, cheapest CPA ranked first, by spend."""
    by_cpa = Window.orderBy(F.asc_nulls_first("country_cpa"))
    ranked = regional_summary(segments).withColumn("efficiency_rank", F.rank().over(by_cpa))
    order = [F.desc("country_spend"), F.asc_nulls_first("country")]
    return numbered(ranked, order).select(
        "position",
        "country",
        kpi.rounded(F.col("country_spend"), 2).alias("spend"),
        F.col("country_conversions").alias("conversions"),
        kpi.rounded(F.col("country_cpa"), 2).alias("cpa"),
        "active_platforms",
        "efficiency_rank",
    )


def top_issues(segments: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Segments well over target, those with the most spend first."""
    cpa, target = F.col("blended_cpa"), F.col("target_cpa")
    issues = segments.withColumn("target_cpa", kpi.target_cpa(F.col("platform"), settings)).where(
        cpa > target * settings.over_target
    )
    return top_k(issues, [F.desc("total_spend"), *ascending(*_SEGMENT)], settings.weekly_top).select(
        "position",
        F.concat(F.col("platform"), F.lit(" - "), F.col("country")).alias("description"),
        kpi.rounded(cpa, 2).alias("current_cpa"),
        target,
        kpi.rounded((cpa - target) / target * 100, 1).alias("overspend_pct"),
        kpi.rounded(F.col("total_spend"), 2).alias("financial_impact"),
    )


def scale_opportunities(segments: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Segments well under target, those that can take the most extra spend first."""
    cpa, target = F.col("blended_cpa"), F.col("target_cpa")
    potential = F.round(kpi.scale_potential(F.col("total_spend"), settings), 0).cast("bigint")
    chances = (
        segments.withColumn("target_cpa", kpi.target_cpa(F.col("platform"), settings))
        .where(cpa <= target * settings.under_target)
        .withColumn("additional_spend_potential", potential)
    )
    order = [F.desc("additional_spend_potential"), *ascending(*_SEGMENT)]
    dash = F.lit(" - ")
    return top_k(chances, order, settings.weekly_top).select(
        "position",
        F.concat(
            F.col("platform"), dash, F.col("country"), dash, F.col("campaign_objective")
        ).alias("description"),
        kpi.rounded(cpa, 2).alias("current_cpa"),
        target,
        kpi.rounded((target - cpa) / target * 100, 1).alias("efficiency_margin"),
        kpi.rounded(F.col("total_spend"), 2).alias("current_spend"),
        "additional_spend_potential",
    )


def report(
    facts: DataFrame,
    as_of: date,
    date_range: str = "7d",
    platforms: Sequence[str] = REPORT_PLATFORMS,
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """The packed report: one scan of the facts, then four sections of its segments."""
    segments = shared(base(facts, as_of, date_range, platforms, countries, settings))
    header = {
        "analysis_period": params.window_label(date_range, periods.range_days(date_range)),
        "platforms_analyzed": params.platforms(platforms),
        "countries_analyzed": params.names(countries, "countries"),
    }
    packed = sections.report(
        [
            sections.pack(
                "PLATFORM_OVERVIEW",
                "platform_performance",
                platform_overview(segments, settings),
                header,
            ),
            sections.pack("REGIONAL_OVERVIEW", "regional_performance", regional_overview(segments)),
            sections.pack("TOP_ISSUES", "performance_issues", top_issues(segments, settings)),
            sections.pack(
                "SCALE_OPPORTUNITIES", "opportunities", scale_opportunities(segments, settings)
            ),
        ]
    )
    return released_with(packed, segments)
