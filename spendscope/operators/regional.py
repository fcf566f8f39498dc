"""Regional comparison: countries and platforms, with the trend of their CPA."""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.functions import kpi, periods, sketches, text
from spendscope.plans import params, sections
from spendscope.plans.materialize import released_with, shared
from spendscope.plans.ranking import global_rank
from spendscope.settings import SETTINGS, Settings
from spendscope.sources.schemas import require_columns

DEFAULT_PLATFORMS = ("Meta", "Google")
COMPARISON_TYPES = ("country", "platform_by_country")
_KEYS = ["platform", "country", "campaign_objective"]
_COLUMNS = ["date", *_KEYS, "campaign_id", "spend", "conversions", "clicks", "impressions"]


def _spending(facts: DataFrame, platforms: Sequence[str]) -> DataFrame:
    return (
        require_columns(facts, _COLUMNS)
        .where(text.in_list(F.col("platform"), params.platforms(platforms)))
        .where(F.col("spend") > 0)
    )


def current(
    facts: DataFrame,
    as_of: date,
    platforms: Sequence[str] = DEFAULT_PLATFORMS,
    date_range: str = "14d",
    with_sketches: bool = False,
) -> DataFrame:
    spend, conversions = F.sum("spend"), F.sum("conversions")
    more = [sketches.distinct_sketch(F.col("campaign_id")).alias("campaign_sketch")] if with_sketches else []
    return (
        _spending(facts, platforms)
        .where(periods.current(as_of, periods.range_days(date_range)))
        .groupBy(*_KEYS)
        .agg(
            spend.alias("spend_current"),
            conversions.alias("conversions_current"),
            kpi.cpa(spend, conversions).alias("cpa_current"),
            kpi.ctr(F.sum("clicks"), F.sum("impressions")).alias("ctr_current"),
            F.countDistinct("campaign_id").alias("campaign_count_current"),
            *more,
        )
    )


def previous(
    facts: DataFrame,
    as_of: date,
    platforms: Sequence[str] = DEFAULT_PLATFORMS,
    date_range: str = "14d",
) -> DataFrame:
    days = periods.range_days(date_range)
    spend, conversions = F.sum("spend"), F.sum("conversions")
    return (
        _spending(facts, platforms)
        .where(periods.comparison(as_of, days, 2 * days))
        .groupBy(*_KEYS)
        .agg(
            spend.alias("spend_previous"),
            conversions.alias("conversions_previous"),
            kpi.cpa(spend, conversions).alias("cpa_previous"),
        )
    )


def _both_periods(
    facts: DataFrame, as_of: date, platforms: Sequence[str], date_range: str, with_sketches: bool
) -> DataFrame:
    """Current and previous segments side by side, from one scan and one shuffle.

    Both periods have the same key, so conditional sums replace the left join: a
    segment needs current rows, and one with a NULL in its key has no previous values
    because NULL equals nothing.
    """
    days = periods.range_days(date_range)
    now = periods.current(as_of, days)
    comparable = F.col("country").isNotNull() & F.col("campaign_objective").isNotNull()

    def total(metric: str, condition):
        return F.sum(F.when(condition, F.col(metric)))

    ids = F.when(now, F.col("campaign_id"))
    more = [sketches.distinct_sketch(ids).alias("campaign_sketch")] if with_sketches else []
    return (
        _spending(facts, platforms)
        .where(periods.current(as_of, 2 * days))
        .groupBy(*_KEYS)
        .agg(
            total("spend", now).alias("spend_current"),
            total("conversions", now).alias("conversions_current"),
            kpi.ctr(total("clicks", now), total("impressions", now)).alias("ctr_current"),
            F.countDistinct(ids).alias("campaign_count_current"),
            *more,
            total("spend", ~now & comparable).alias("spend_previous"),
            total("conversions", ~now & comparable).alias("conversions_previous"),
        )
        # spend is above zero in every row, so a NULL sum means no current rows
        .where(F.col("spend_current").isNotNull())
        .withColumns(
            {
                "cpa_current": kpi.cpa(F.col("spend_current"), F.col("conversions_current")),
                "cpa_previous": kpi.cpa(F.col("spend_previous"), F.col("conversions_previous")),
            }
        )
        .withColumn("cpa_change_pct", kpi.pct_change(F.col("cpa_current"), F.col("cpa_previous")))
    )


def performance(
    facts: DataFrame,
    as_of: date,
    platforms: Sequence[str] = DEFAULT_PLATFORMS,
    date_range: str = "14d",
    include_trends: bool = True,
    settings: Settings = SETTINGS,
    with_sketches: bool = False,
) -> DataFrame:
    """Segments with enough current spend, their trend and rating. Without trends the
    columns of the previous period are there, and NULL. With ``with_sketches`` each has a
    ``campaign_sketch``, and countries gain ``distinct_campaigns``."""
    if include_trends:
        segments = _both_periods(facts, as_of, platforms, date_range, with_sketches)
    else:
        segments = current(facts, as_of, platforms, date_range, with_sketches)
        for name in ("spend", "conversions", "cpa"):
            same_type = segments.schema[f"{name}_current"].dataType
            segments = segments.withColumn(f"{name}_previous", F.lit(None).cast(same_type))
        change = kpi.pct_change(F.col("cpa_current"), F.col("cpa_previous"))
        segments = segments.withColumn("cpa_change_pct", change)
    return segments.where(F.col("spend_current") >= settings.min_segment_spend).select(
        *_KEYS,
        "spend_current",
        "conversions_current",
        "cpa_current",
        "ctr_current",
        "campaign_count_current",
        "spend_previous",
        "conversions_previous",
        "cpa_previous",
        "cpa_change_pct",
        kpi.performance_rating(F.col("cpa_current"), settings).alias("performance_rating"),
        *(["campaign_sketch"] if with_sketches else []),
    )


def country_summary(segments: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    spend, conversions = F.sum("spend_current"), F.sum("conversions_current")
    rating = F.col("performance_rating")
    merged = sketches.merged_distinct(F.col("campaign_sketch"))
    more = [sketches.distinct_estimate(merged).alias("distinct_campaigns")] if "campaign_sketch" in segments.columns else []
    return (
        segments.groupBy("country")
        .agg(
            spend.alias("total_spend"),
            conversions.alias("total_conversions"),
            kpi.cpa(spend, conversions).alias("blended_cpa"),
            F.avg("ctr_current").alias("avg_ctr"),
            F.sum("campaign_count_current").alias("total_campaigns"),
            F.countDistinct("platform").alias("active_platforms"),
            kpi.mean(F.col("cpa_change_pct")).alias("avg_cpa_change"),
            kpi.count_if(rating.isin("EXCELLENT", "GOOD")).alias("strong_segments"),
            kpi.count_if(rating == "NEEDS_ATTENTION").alias("weak_segments"),
            *more,
        )
        .where(F.col("total_spend") >= settings.min_country_spend)
    )


def country_ranked(countries: DataFrame, kept: list[DataFrame] | None = None) -> DataFrame:
    """Numbered by CPA; a country without conversions has no CPA and comes first. ``kept``
    is that of ``global_rank``, here and in the sections."""
    return global_rank(countries, ["blended_cpa", "country"], "efficiency_rank", kept)


def platform_country(segments: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    spend, conversions = F.sum("spend_current"), F.sum("conversions_current")
    return (
        segments.groupBy("platform", "country")
        .agg(
            spend.alias("platform_country_spend"),
            conversions.alias("platform_country_conversions"),
            kpi.cpa(spend, conversions).alias("platform_country_cpa"),
            F.avg("ctr_current").alias("platform_country_ctr"),
            kpi.mean(F.col("cpa_change_pct")).alias("platform_country_change"),
            F.count("*").alias("segment_count"),
        )
        .where(F.col("platform_country_spend") >= settings.min_platform_country_spend)
    )


def _shown_change(column: str):
    return kpi.rounded(F.coalesce(F.col(column), F.lit(0.0)), 1)


def country_section(ranked: DataFrame, kept: list[DataFrame] | None = None) -> DataFrame:
    return global_rank(ranked, ["-total_spend", "country"], kept=kept).select(
        "position",
        "country",
        kpi.rounded(F.col("total_spend"), 2).alias("total_spend"),
        "total_conversions",
        kpi.rounded(F.col("blended_cpa"), 2).alias("blended_cpa"),
        kpi.rounded(F.col("avg_ctr"), 2).alias("avg_ctr"),
        "total_campaigns",
        "active_platforms",
        _shown_change("avg_cpa_change").alias("avg_cpa_change_pct"),
        "strong_segments",
        "weak_segments",
        "efficiency_rank",
    )


def platform_country_section(matrix: DataFrame, kept: list[DataFrame] | None = None) -> DataFrame:
    return global_rank(matrix, ["platform", "platform_country_cpa", "country"], kept=kept).select(
        "position",
        "platform",
        "country",
        kpi.rounded(F.col("platform_country_spend"), 2).alias("spend"),
        F.col("platform_country_conversions").alias("conversions"),
        kpi.rounded(F.col("platform_country_cpa"), 2).alias("cpa"),
        kpi.rounded(F.col("platform_country_ctr"), 2).alias("ctr"),
        _shown_change("platform_country_change").alias("cpa_change_pct"),
        F.col("segment_count").alias("segments_analyzed"),
    )


def insights(
    ranked: DataFrame, include_trends: bool = True, settings: Settings = SETTINGS
) -> DataFrame:
    """One row: the outstanding countries, found in one aggregation of the ranking."""
    country, change = F.col("country"), F.col("avg_cpa_change")
    most_improved = (
        F.min_by(country, F.when(change.isNotNull(), F.struct(change, country)))
        if include_trends
        else F.lit("Trend analysis disabled")
    )
    weak = F.sort_array(
        F.collect_list(F.when(F.col("weak_segments") >= settings.weak_segments_alert, country))
    )
    return ranked.agg(
        F.min_by(country, F.col("efficiency_rank")).alias("best_performing_country"),
        F.min_by(country, F.struct(-F.col("total_spend"), country)).alias("highest_spend_country"),
        most_improved.alias("most_improved"),
        F.when(F.size(weak) > 0, weak).alias("needs_attention"),
        F.count("*").alias("total_countries_analyzed"),
    )


def report(
    facts: DataFrame,
    as_of: date,
    platforms: Sequence[str] = DEFAULT_PLATFORMS,
    comparison_type: str = "country",
    date_range: str = "14d",
    include_trends: bool = True,
    settings: Settings = SETTINGS,
    items_per_row: int = sections.ITEMS_PER_ROW,
) -> DataFrame:
    """The packed report. All three sections always appear; of the two comparisons the
    one not asked for has a NULL array. Comparisons come in parts of ``items_per_row``."""
    params.choice(comparison_type, COMPARISON_TYPES, "comparison_type")
    segments = shared(
        performance(facts, as_of, platforms, date_range, include_trends, settings)
    )
    kept: list[DataFrame] = []
    ranked = country_ranked(country_summary(segments, settings), kept)
    by_country = country_section(ranked, kept)
    by_platform = platform_country_section(platform_country(segments, settings), kept)
    if comparison_type == "country":
        by_platform = by_platform.where(F.lit(False))
    else:
        by_country = by_country.where(F.lit(False))
    header = {
        "analysis_type": comparison_type,
        "platforms_analyzed": params.platforms(platforms),
        "period": params.window_label(date_range, periods.range_days(date_range)),
        "trend_analysis_included": include_trends,
    }
    findings = insights(ranked, include_trends, settings)
    packed = sections.report(
        [
            sections.pack_parts(
                "COUNTRY_COMPARISON", "country_performance", by_country, header, items_per_row
            ),
            sections.pack_parts(
                "PLATFORM_BY_COUNTRY",
                "platform_country_matrix",
                by_platform,
                {"analysis_note": "Platform performance breakdown by country"},
                items_per_row,
            ),
            findings.select(
                *sections.section(
                    "REGIONAL_INSIGHTS",
                    sections.json_object({"key_findings": F.struct(*findings.columns)}),
                )
            ),
        ]
    )
    return released_with(packed, segments, *kept)
