"""Thresholds, targets and limits used by every report.

A report takes a ``Settings`` object, so a caller can change a threshold with
``dataclasses.replace(SETTINGS, min_segment_spend=1000)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping


@dataclass(frozen=True)
class Sensitivity:
    """How large a shift, and how much data behind it, makes an anomaly."""

    change: float
    min_spend: int
    min_conversions: int


# ---------------------------------------------------------------------------
# They define the meaning of the reports and must not drift.
# ---------------------------------------------------------------------------
PLATFORM_TARGET_CPA = MappingProxyType(
    {"Meta": 50.0, "Google": 25.0, "Bing": 25.0, "TikTok": 50.0}
)
DEFAULT_TARGET_CPA = 40.0
REPORT_PLATFORMS = ("Meta", "Google", "Bing")
DEFAULT_COUNTRIES = ("US", "AU", "UK")
DATE_RANGE_DAYS = MappingProxyType({"7d": 7, "14d": 14, "30d": 30})
COMPARISON_DAYS = MappingProxyType(
    {"week_over_week": (7, 14), "month_over_month": (30, 60)}
)
SENSITIVITY = MappingProxyType(
    {
        "high": Sensitivity(0.15, 300, 3),
        "medium": Sensitivity(0.25, 500, 5),
        "low": Sensitivity(0.5, 1000, 8),
    }
)


@dataclass(frozen=True)
class Settings:
    """Fixed values too: the defaults below are those of the reports."""

    # cost per acquisition
    platform_target_cpa: Mapping[str, float] = field(default=PLATFORM_TARGET_CPA)
    default_target_cpa: float = DEFAULT_TARGET_CPA
    excellent_cpa: float = 25.0
    good_cpa: float = 40.0
    acceptable_cpa: float = 60.0
    # share of the target that still counts as well under / tolerably over it
    under_target: float = 0.8
    over_target: float = 1.2

    # weekly report
    weekly_min_spend: int = 500
    weekly_min_conversions: int = 5
    weekly_top: int = 5
    scale_small_below: int = 500
    scale_medium_below: int = 1500
    scale_small: float = 1.0
    scale_medium: float = 0.5
    scale_large: float = 0.2

    # campaign analysis
    top_performer_min_spend: int = 200
    top_performers: int = 10
    problem_min_spend: int = 1000
    problem_min_cpa: int = 50
    campaign_creative_min_spend: int = 100
    campaign_creative_min_conversions: int = 2
    campaign_creatives: int = 10

    # creative analysis
    creative_min_conversions: int = 2
    concept_spend_multiplier: int = 2
    top_concepts: int = 8
    top_ads: int = 10

    # regional comparison
    min_segment_spend: int = 500
    min_country_spend: int = 1000
    min_platform_country_spend: int = 500
    weak_segments_alert: int = 2

    # anomaly detection
    anomaly_days: tuple[int, int] = (7, 14)
    min_excess_cost: int = 500
    min_regional_excess_cost: int = 1000
    high_regional_excess_cost: int = 2000
    volatile_campaigns_alert: int = 2
    campaign_anomalies: int = 15
    regional_anomalies: int = 10

    # impression share
    high_lost_share: float = 30.0
    actionable_lost_share: float = 15.0
    min_impressions: int = 1000
    min_clicks: int = 10
    high_utilization: float = 85.0
    low_utilization: float = 60.0
    overview_campaigns: int = 10
    budget_campaigns: int = 8
    rank_campaigns: int = 8
    regional_campaigns: int = 6

    # ad-hoc SQL
    max_query_length: int = 10_000


SETTINGS = Settings()
