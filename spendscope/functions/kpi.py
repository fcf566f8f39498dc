"""Column functions for advertising KPIs. Column in, Column out; no UDFs.

Sums stay in the type Spark gives them (decimal or bigint, so exact and free of
order); ratios are taken once, in double, with NULL for a zero denominator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendscope.settings import REPORT_PLATFORMS, SETTINGS, Sensitivity, Settings


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def cpa(spend: Column, conversions: Column) -> Column:
    """Cost per acquisition."""
    return ratio(spend, conversions)


def ctr(clicks: Column, impressions: Column) -> Column:
    """Click-through rate in percent."""
    return ratio(clicks, impressions) * 100


def cvr(conversions: Column, clicks: Column) -> Column:
    """Conversion rate in percent."""
    return ratio(conversions, clicks) * 100


def rounded(value: Column, places: int) -> Column:
    """Half-up rounding in decimal, so 6.175 gives 6.18 and JSON prints no exponent."""
    return F.round(value.cast("decimal(38,10)"), places)


def mean(value: Column) -> Column:
    """AVG of a decimal or integer column as exact sum over count, in double."""
    return ratio(F.sum(value), F.count(value))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows without a value still count with their weight in the denominator."""
    return ratio(F.sum(value * weight), F.sum(weight))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def magnitude(change: Column) -> Column:
    """Size of a change; an unknown change has size 0."""
    return F.abs(F.coalesce(change, F.lit(0.0)))


def fractional_change(current: Column, previous: Column) -> Column:
    return F.when(previous > 0, (current - previous) / previous)


def pct_change(current: Column, previous: Column, places: int = 1) -> Column:
    """Percent change, NULL unless the previous value is above zero."""
    return F.when(previous > 0, rounded((current - previous) / previous * 100, places))


def impression_share_change(current: Column, previous: Column) -> Column:
    return pct_change(current.cast("double"), previous.cast("double"))


def performance_rating(cpa_value: Column, settings: Settings = SETTINGS) -> Column:
    """An unknown CPA needs attention."""
    return (
        F.when(cpa_value <= settings.excellent_cpa, "EXCELLENT")
        .when(cpa_value <= settings.good_cpa, "GOOD")
        .when(cpa_value <= settings.acceptable_cpa, "ACCEPTABLE")
        .otherwise("NEEDS_ATTENTION")
    )


def target_cpa(
    platform: Column,
    settings: Settings = SETTINGS,
    platforms: tuple[str, ...] | None = REPORT_PLATFORMS,
) -> Column:
    """Target CPA of a platform. Reports know three platforms and give every other
    one the default; ``platforms=None`` looks up the whole target table."""
    names = settings.platform_target_cpa if platforms is None else platforms
    known = F.create_map(
        *[F.lit(x) for name in names for x in (name, settings.platform_target_cpa[name])]
    )
    # a map lookup with a NULL key is NULL, so a NULL platform gets the default too
    return F.coalesce(F.try_element_at(known, platform), F.lit(settings.default_target_cpa))


def target_status(cpa_value: Column, target: Column, settings: Settings = SETTINGS) -> Column:
    return (
        F.when(cpa_value <= target * settings.under_target, "EXCELLENT")
        .when(cpa_value <= target, "ON_TARGET")
        .when(cpa_value <= target * settings.over_target, "ACCEPTABLE")
        .otherwise("NEEDS_ATTENTION")
    )


def scale_potential(spend: Column, settings: Settings = SETTINGS) -> Column:
    """Extra spend a segment can take: the smaller it is, the larger the share."""
    share = (
        F.when(spend < settings.scale_small_below, F.lit(settings.scale_small))
        .when(spend < settings.scale_medium_below, F.lit(settings.scale_medium))
        .otherwise(F.lit(settings.scale_large))
    )
    return spend.cast("decimal(28,4)") * share.cast("decimal(4,2)")


def excess_cost(spend: Column, conversions: Column, target: Column) -> Column:
    """Spend above what the conversions would have cost at target.

    (cpa - target) * conversions, written without the division so that it is
    exact and can be summed in any order. Zero at or under target and when there
    are no conversions.
    """
    over = spend - target.cast("decimal(10,2)") * conversions
    return F.when(cpa(spend, conversions) > target, over.cast("decimal(38,4)")).otherwise(
        F.lit(0).cast("decimal(38,4)")
    )


def confidence_level(spend: Column, conversions: Column, level: Sensitivity) -> Column:
    def reaches(spend_times: int, conversion_times: int) -> Column:
        return (spend >= level.min_spend * spend_times) & (
            conversions >= level.min_conversions * conversion_times
        )

    return (
        F.when(reaches(4, 3), "HIGH")
        .when(reaches(2, 2), "MEDIUM")
        .when(reaches(1, 1), "LOW")
        .otherwise("INSUFFICIENT")
    )


def total_lost_share(budget_lost: Column, rank_lost: Column) -> Column:
    return F.coalesce(budget_lost, F.lit(0)) + F.coalesce(rank_lost, F.lit(0))


def opportunity_type(
    budget_lost: Column, rank_lost: Column, settings: Settings = SETTINGS
) -> Column:
    budget = F.coalesce(budget_lost, F.lit(0))
    rank = F.coalesce(rank_lost, F.lit(0))
    high, actionable = settings.high_lost_share, settings.actionable_lost_share
    return (
        F.when(budget >= high, "BUDGET_OPPORTUNITY")
        .when(rank >= high, "RANK_OPPORTUNITY")
        .when(budget >= actionable, "BUDGET_CONSTRAINED")
        .when(rank >= actionable, "RANK_IMPROVEMENT")
        .when(budget + rank >= actionable, "MIXED_OPPORTUNITY")
        .otherwise("OPTIMIZED")
    )


def budget_status(utilization: Column, settings: Settings = SETTINGS) -> Column:
    return (
        F.when(utilization >= settings.high_utilization, "CONSTRAINED")
        .when(utilization <= settings.low_utilization, "UNDERUTILIZED")
        .otherwise("BALANCED")
    )


def market_opportunity_score(budget_lost: Column, rank_lost: Column, market_size: Column) -> Column:
    """Score by total lost share. The top band grows with the market and may pass 100."""
    lost = total_lost_share(budget_lost, rank_lost).cast("double")
    market = F.coalesce(market_size, F.lit(0)).cast("double")
    return (
        F.when(lost >= 50, market / 100000 + 90)
        .when(lost >= 30, lost * 0.5 + 70)
        .when(lost >= 15, lost * 0.8 + 50)
        .otherwise(lost * 1.5 + 20)
    )
