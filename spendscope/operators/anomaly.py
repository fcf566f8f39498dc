"""Anomaly detection: campaigns and regions that moved since the week before.

The two windows do not overlap, so on a table partitioned by day the two scans read
every day once. Each side is aggregated to its own key before the join, which then
works on campaign-level rows.
"""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.functions import kpi, periods, text
from spendscope.plans import params, sections
from spendscope.plans.materialize import released_with, shared
from spendscope.plans.ranking import ascending, top_k
from spendscope.settings import (
    DEFAULT_COUNTRIES,
    REPORT_PLATFORMS,
    SENSITIVITY,
    SETTINGS,
    Sensitivity,
    Settings,
)
from spendscope.sources.schemas import require_columns

_KEYS = ["platform", "country", "campaign_objective", "campaign_id", "campaign"]
_JOIN_KEYS = ["campaign_id", "platform", "country"]
_COLUMNS = ["date", *_KEYS, "spend", "conversions", "clicks", "impressions"]


def level(sensitivity: str) -> Sensitivity:
    return SENSITIVITY[params.choice(sensitivity, list(SENSITIVITY), "sensitivity")]


def effective_min_impact(min_impact_threshold: float) -> float:
    return params.clamped(min_impact_threshold, 100, 50_000)


def _period(
    facts: DataFrame,
    in_period: Column,
    platforms: Sequence[str],
    countries: Sequence[str],
    name: str,
) -> DataFrame:
    spend, conversions, clicks = F.sum("spend"), F.sum("conversions"), F.sum("clicks")
    return (
        require_columns(facts, _COLUMNS)
        .where(in_period)
        .where(text.in_list(F.col("platform"), params.platforms(platforms)))
        .where(text.in_list(F.col("country"), params.names(countries, "countries")))
        .where(F.col("spend") > 0)
        .groupBy(*_KEYS)
        .agg(
            spend.alias(f"spend_{name}"),
            conversions.alias(f"conversions_{name}"),
            kpi.cpa(spend, conversions).alias(f"cpa_{name}"),
            kpi.ctr(clicks, F.sum("impressions")).alias(f"ctr_{name}"),
            kpi.cvr(conversions, clicks).alias(f"cvr_{name}"),
            F.countDistinct("date").alias(f"active_days_{name}"),
        )
    )


def current(
    facts: DataFrame,
    as_of: date,
    platforms: Sequence[str] = REPORT_PLATFORMS,
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    settings: Settings = SETTINGS,
) -> DataFrame:
    days, _ = settings.anomaly_days
    return _period(facts, periods.current(as_of, days), platforms, countries, "current")


def comparison(
    facts: DataFrame,
    as_of: date,
    platforms: Sequence[str] = REPORT_PLATFORMS,
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    settings: Settings = SETTINGS,
) -> DataFrame:
    window = periods.comparison(as_of, *settings.anomaly_days)
    return _period(facts, window, platforms, countries, "comparison")


def features(
    facts: DataFrame,
    as_of: date,
    sensitivity: str = "medium",
    platforms: Sequence[str] = REPORT_PLATFORMS,
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    min_impact_threshold: float = 1000,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Campaigns with enough spend, their changes, confidence and excess cost.

    The join key is narrower than the group key: a campaign with several objectives
    or names in both weeks gives every pairing of them.
    """
    now = current(facts, as_of, platforms, countries, settings).where(
        F.col("spend_current") >= effective_min_impact(min_impact_threshold)
    )
    before = comparison(facts, as_of, platforms, countries, settings).select(
        *_JOIN_KEYS,
        *[f"{m}_comparison" for m in ("spend", "conversions", "cpa", "ctr", "cvr")],
    )
    spend, conversions = F.col("spend_current"), F.col("conversions_current")

    def change(metric: str) -> Column:
        return kpi.fractional_change(
            F.col(f"{metric}_current").cast("double"), F.col(f"{metric}_comparison").cast("double")
        )

    return (
        now.drop("active_days_current")
        .join(before, _JOIN_KEYS, "left")
        .withColumn("target_cpa", kpi.target_cpa(F.col("platform"), settings))
        .withColumns(
            {
                **{f"{m}_change_pct": change(m) for m in ("cpa", "ctr", "cvr", "spend")},
                "confidence_level": kpi.confidence_level(spend, conversions, level(sensitivity)),
                "excess_cost": kpi.excess_cost(spend, conversions, F.col("target_cpa")),
            }
        )
    )


def _impact(excess: str, change: str, spend: str) -> Column:
    moved = kpi.magnitude(F.col(change)) * F.col(spend).cast("double")
    return F.when(F.col(excess) > 0, F.col(excess).cast("double")).otherwise(moved)


def regional(features: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Campaigns with enough data rolled up to platform and country."""
    spend, conversions = F.sum("spend_current"), F.sum("conversions_current")
    old_spend, old_conversions = F.sum("spend_comparison"), F.sum("conversions_comparison")
    volatile = kpi.magnitude(F.col("cpa_change_pct")) >= level(sensitivity).change
    return (
        features.where(F.col("confidence_level") != "INSUFFICIENT")
        .groupBy("platform", "country")
        .agg(
            spend.alias("total_spend_current"),
            conversions.alias("total_conversions_current"),
            kpi.cpa(spend, conversions).alias("blended_cpa_current"),
            old_spend.alias("total_spend_comparison"),
            old_conversions.alias("total_conversions_comparison"),
            kpi.cpa(old_spend, old_conversions).alias("blended_cpa_comparison"),
            F.count("*").alias("campaign_count"),
            kpi.count_if(F.col("confidence_level") == "HIGH").alias("high_confidence_campaigns"),
            kpi.count_if(volatile).alias("volatile_campaigns"),
            F.sum("excess_cost").alias("total_excess_cost"),
        )
        .withColumn(
            "regional_cpa_change",
            kpi.fractional_change(F.col("blended_cpa_current"), F.col("blended_cpa_comparison")),
        )
    )


def _campaign_signals(sensitivity: str, settings: Settings) -> list[tuple[str, Column]]:
    """What makes a campaign an anomaly, most telling first."""
    change = level(sensitivity).change
    return [
        ("CPA_SHIFT", kpi.magnitude(F.col("cpa_change_pct")) >= change),
        ("CTR_SHIFT", kpi.magnitude(F.col("ctr_change_pct")) >= change),
        ("CVR_SHIFT", kpi.magnitude(F.col("cvr_change_pct")) >= change),
        ("SPEND_SHIFT", kpi.magnitude(F.col("spend_change_pct")) >= change * 2),
        ("COST_OVERRUN", F.col("excess_cost") >= settings.min_excess_cost),
    ]


def _first_signal(signals: list[tuple[str, Column]], otherwise: str) -> Column:
    return F.coalesce(*[F.when(holds, name) for name, holds in signals], F.lit(otherwise))


def significant_campaigns(
    features: DataFrame, sensitivity: str = "medium", settings: Settings = SETTINGS
) -> DataFrame:
    """The campaigns with the most at stake among those that show a signal."""
    signals = _campaign_signals(sensitivity, settings)
    kind = _first_signal(signals, "NONE")
    order = [_impact("excess_cost", "cpa_change_pct", "spend_current").desc()]
    order += ascending(*_JOIN_KEYS, "campaign_objective", "campaign", "spend_comparison",
                       "conversions_comparison")
    found = features.where(F.col("confidence_level") != "INSUFFICIENT").where(kind != "NONE")
    return top_k(found, order, settings.campaign_anomalies)


def _percent(change: str) -> Column:
    return kpi.rounded(F.coalesce(F.col(change), F.lit(0.0)) * 100, 1)


def campaign_section(
    significant: DataFrame, sensitivity: str = "medium", settings: Settings = SETTINGS
) -> DataFrame:
    signals = _campaign_signals(sensitivity, settings)
    return significant.select(
        "position",
        F.col("campaign").alias("campaign_name"),
        "platform",
        "country",
        "campaign_objective",
        kpi.rounded(F.col("spend_current"), 2).alias("current_spend"),
        F.col("conversions_current").alias("current_conversions"),
        kpi.rounded(F.col("cpa_current"), 2).alias("current_cpa"),
        "target_cpa",
        *[_percent(f"{m}_change_pct").alias(f"{m}_change_pct") for m in ("cpa", "ctr", "cvr", "spend")],
        "confidence_level",
        kpi.rounded(F.col("excess_cost"), 2).alias("excess_cost"),
        _first_signal(signals, "MULTIPLE_SIGNALS").alias("anomaly_type"),
    )


def significant_regions(
    regions: DataFrame,
    sensitivity: str = "medium",
    min_impact_threshold: float = 1000,
    settings: Settings = SETTINGS,
) -> DataFrame:
    signal = (
        (kpi.magnitude(F.col("regional_cpa_change")) >= level(sensitivity).change)
        | (F.col("volatile_campaigns") >= settings.volatile_campaigns_alert)
        | (F.col("total_excess_cost") >= settings.min_regional_excess_cost)
    )
    found = regions.where(
        F.col("total_spend_current") >= effective_min_impact(min_impact_threshold)
    ).where(signal)
    order = [
        _impact("total_excess_cost", "regional_cpa_change", "total_spend_current").desc(),
        *ascending("platform", "country"),
    ]
    return top_k(found, order, settings.regional_anomalies)


def region_section(
    significant: DataFrame, sensitivity: str = "medium", settings: Settings = SETTINGS
) -> DataFrame:
    patterns = [
        ("WIDESPREAD_VOLATILITY", F.col("volatile_campaigns") >= F.col("campaign_count") * 0.5),
        (
            "MAJOR_SHIFT",
            kpi.magnitude(F.col("regional_cpa_change")) >= level(sensitivity).change * 1.5,
        ),
        ("HIGH_COST_IMPACT", F.col("total_excess_cost") >= settings.high_regional_excess_cost),
    ]
    known_before = F.coalesce(F.col("blended_cpa_comparison"), F.lit(0.0))
    return significant.select(
        "position",
        "platform",
        "country",
        kpi.rounded(F.col("total_spend_current"), 2).alias("total_spend_current"),
        "total_conversions_current",
        kpi.rounded(F.col("blended_cpa_current"), 2).alias("blended_cpa_current"),
        kpi.rounded(known_before, 2).alias("blended_cpa_comparison"),
        _percent("regional_cpa_change").alias("regional_cpa_change_pct"),
        "campaign_count",
        "high_confidence_campaigns",
        "volatile_campaigns",
        kpi.rounded(F.col("total_excess_cost"), 2).alias("total_excess_cost"),
        _first_signal(patterns, "NOTABLE_CHANGE").alias("pattern_type"),
    )


def summary(campaigns: DataFrame, regions: DataFrame) -> DataFrame:
    """One row of counts, also when nothing was found."""
    return campaigns.sparkSession.range(1).select(
        campaigns.agg(F.count("*")).scalar().alias("total_campaign_anomalies"),
        regions.agg(F.count("*")).scalar().alias("total_regional_anomalies"),
        kpi.rounded(campaigns.agg(F.sum("excess_cost")).scalar(), 2).alias("total_excess_cost"),
    )


def report(
    facts: DataFrame,
    as_of: date,
    sensitivity: str = "medium",
    platforms: Sequence[str] = REPORT_PLATFORMS,
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    min_impact_threshold: float = 1000,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """The packed report, all from one evaluation of the campaign features."""
    campaigns = shared(
        features(facts, as_of, sensitivity, platforms, countries, min_impact_threshold, settings)
    )
    top_campaigns = significant_campaigns(campaigns, sensitivity, settings)
    top_regions = significant_regions(
        regional(campaigns, sensitivity), sensitivity, min_impact_threshold, settings
    )
    header = {
        "detection_sensitivity": sensitivity,
        "change_threshold_pct": level(sensitivity).change * 100,
        "platforms_analyzed": params.platforms(platforms),
        "countries_analyzed": params.names(countries, "countries"),
        "min_impact_threshold": effective_min_impact(min_impact_threshold),
    }
    counts = summary(top_campaigns, top_regions)
    packed = sections.report(
        [
            counts.select(
                *sections.section(
                    "ANOMALY_SUMMARY",
                    sections.json_object({**header, **{c: F.col(c) for c in counts.columns}}),
                )
            ),
            sections.pack(
                "CAMPAIGN_ANOMALIES",
                "significant_campaign_changes",
                sections.cut(
                    campaign_section(top_campaigns, sensitivity, settings), campaign_name=80
                ),
            ),
            sections.pack(
                "REGIONAL_ANOMALIES",
                "regional_pattern_changes",
                region_section(top_regions, sensitivity, settings),
            ),
        ]
    )
    return released_with(packed, campaigns)
