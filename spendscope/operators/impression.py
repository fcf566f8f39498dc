"""Impression share analysis: search visibility lost to budget and to rank."""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.functions import kpi, periods, sketches, text
from spendscope.plans import params, sections
from spendscope.plans.materialize import released_with, shared
from spendscope.plans.ranking import ascending, global_rank, numbered, top_k
from spendscope.settings import DEFAULT_COUNTRIES, SETTINGS, Settings
from spendscope.sources.schemas import require_columns

ANALYSIS_TYPES = ("overview", "budget_opportunities", "rank_opportunities", "regional_comparison")
_KEYS = ["region", "campaign", "campaign_type", "campaign_category", "funnel_stage",
         "is_brand_campaign"]

# result name -> fact column, for the plain sums
_SUMS = {
    "total_spend": "spend",
    "total_conversions": "conversions",
    "total_clicks": "clicks",
    "total_impressions": "actual_impressions",
    "total_market_size": "market_size_impressions",
    "additional_budget_needed": "estimated_budget_needed_for_lost_impressions",
    "potential_clicks_from_rank": "estimated_clicks_from_rank_improvement",
}
# result name -> (percentage, weight) for the weighted shares
_SHARES = {
    "weighted_impression_share": ("search_impression_share_pct", "actual_impressions"),
    "weighted_top_impression_share": ("search_top_impression_share_pct", "actual_impressions"),
    "weighted_absolute_top_share": (
        "search_absolute_top_impression_share_pct", "actual_impressions"),
    "weighted_budget_lost": ("budget_lost_impression_share_pct", "market_size_impressions"),
    "weighted_rank_lost": ("rank_lost_impression_share_pct", "market_size_impressions"),
}
_MEANS = {
    "avg_budget_utilization": "budget_utilization_pct",
    "avg_wow_change": "wow_impression_share_change",
}
_MODES = {
    "primary_market_position": "market_position",
    "primary_diagnosis": "performance_diagnosis",
}


def effective_min_spend(min_spend_threshold: float) -> float:
    return params.clamped(min_spend_threshold, 100, 10_000)


def base(
    facts: DataFrame,
    as_of: date,
    date_range: str = "14d",
    regions: Sequence[str] = DEFAULT_COUNTRIES,
    include_brand_campaigns: bool = True,
    min_spend_threshold: float = 500,
    settings: Settings = SETTINGS,
    approximate: bool = False,
) -> DataFrame:
    """Campaigns per region with weighted shares and their most frequent position and
    diagnosis (NULL counts as a value, the lowest value wins a tie).

    With ``approximate`` the most frequent values come from sketches of a fixed size in the one
    aggregate of the sums. They are the same while a campaign has no more values than
    ``sketches.TRACKED``; beyond, a value that clearly leads is found, and NULL is given
    where none does.
    """
    needed = ["date", *_KEYS, *_SUMS.values(), *_MEANS.values(), *_MODES.values()]
    needed += [p for p, _ in _SHARES.values()]
    rows = _visible(require_columns(facts, needed), settings).where(
        periods.current(as_of, periods.range_days(date_range))
    ).where(text.in_list(F.col("region"), params.names(regions, "regions")))
    if not include_brand_campaigns:
        rows = rows.where(~F.coalesce(F.col("is_brand_campaign"), F.lit(False)))
    campaigns = _with_sketched_modes(rows) if approximate else _with_modes(rows)
    return (
        campaigns.where(F.col("total_spend") >= effective_min_spend(min_spend_threshold))
        .where(F.col("total_clicks") >= settings.min_clicks)
        .select(
            *_KEYS,
            *_SUMS,
            kpi.cpa(F.col("total_spend"), F.col("total_conversions")).alias("blended_cpa"),
            *[
                kpi.ratio(F.col(name), F.col(f"weight_{w}")).alias(name)
                for name, (_, w) in _SHARES.items()
            ],
            *[
                kpi.ratio(F.col(f"sum_{column}"), F.col(f"count_{column}")).alias(name)
                for name, column in _MEANS.items()
            ],
            *_MODES,
        )
    )


def _visible(facts: DataFrame, settings: Settings) -> DataFrame:
    return facts.where(F.col("spend") > 0).where(F.col("actual_impressions") > settings.min_impressions)


def _additive() -> dict[str, Column]:
    """Everything that sums up from rows to labels to campaigns."""
    weights = sorted({w for _, w in _SHARES.values()})
    return {
        **{name: F.sum(column) for name, column in _SUMS.items()},
        **{name: F.sum(F.col(p) * F.col(w)) for name, (p, w) in _SHARES.items()},
        **{f"weight_{w}": F.sum(w) for w in weights},
        **{f"sum_{column}": F.sum(column) for column in _MEANS.values()},
        **{f"count_{column}": F.count(column) for column in _MEANS.values()},
    }


def _with_modes(rows: DataFrame) -> DataFrame:
    """One hash aggregate over the facts gives additive sums and the count of each pair of
    labels. Its rows are then dealt three ways: once with the sums, and once for each
    label column with the counts. Every step is an aggregate with partial sums, so a
    campaign with many labels is split over tasks until one row per task is left."""
    additive = _additive()
    by_label = rows.groupBy(*_KEYS, *_MODES.values()).agg(
        F.count("*").alias("n"), *[total.alias(name) for name, total in additive.items()]
    )
    ways = [(None, None), *_MODES.items()]
    dealt = by_label.withColumn("way", F.explode(F.array(*[F.lit(i) for i in range(len(ways))])))
    label = F.lit(None).cast("string")
    for i, (_, column) in enumerate(ways[1:], 1):
        label = F.when(F.col("way") == i, F.col(column)).otherwise(label)
    counted = dealt.groupBy(*_KEYS, "way", label.alias("label")).agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("way") == 0, F.col(name))).alias(name) for name in additive],
    )
    first = F.struct(-F.col("n"), F.col("label"))
    return counted.groupBy(*_KEYS).agg(
        *[F.sum(name).alias(name) for name in additive],
        *[
            F.min_by("label", F.when(F.col("way") == i, first)).alias(name)
            for i, (name, _) in enumerate(ways[1:], 1)
        ],
    )


def _with_sketched_modes(rows: DataFrame) -> DataFrame:
    """One aggregate for sums and labels; partial states of a campaign are merged."""
    states = {name: sketches.label_counts(F.col(column)).alias(name) for name, column in _MODES.items()}
    summed = rows.groupBy(*_KEYS).agg(
        *[total.alias(name) for name, total in _additive().items()], *states.values()
    )
    return summed.withColumns({name: sketches.leading_label(F.col(name))["label"] for name in states})


def label_states(
    facts: DataFrame, keys: Sequence[str] = ("date", *_KEYS), settings: Settings = SETTINGS
) -> DataFrame:
    """States of the positions and diagnoses per day and campaign, to be stored; any window
    and any coarser key is answered from them by ``modal_labels``."""
    rows = _visible(require_columns(facts, [*keys, *_MODES.values(), "spend", "actual_impressions"]), settings)
    return rows.groupBy(*keys).agg(*[sketches.label_counts(F.col(c)).alias(c) for c in _MODES.values()])


def modal_labels(
    states: DataFrame, as_of: date, date_range: str = "14d", keys: Sequence[str] = ("region",)
) -> DataFrame:
    """The most frequent position and diagnosis of a window per ``keys``, and how often each
    was seen, from the rows of ``label_states``."""
    merged = (
        states.where(periods.current(as_of, periods.range_days(date_range)))
        .groupBy(*keys)
        .agg(*[sketches.merged_label_counts(F.col(c)).alias(c) for c in _MODES.values()])
    )
    leading = {name: sketches.leading_label(F.col(column)) for name, column in _MODES.items()}
    return merged.select(
        *keys,
        *[found["label"].alias(name) for name, found in leading.items()],
        *[found["count"].alias(f"{name}_rows") for name, found in leading.items()],
    )


def classified(campaigns: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    budget, rank = F.col("weighted_budget_lost"), F.col("weighted_rank_lost")
    market = F.col("total_market_size")
    return campaigns.withColumns(
        {
            "opportunity_type": kpi.opportunity_type(budget, rank, settings),
            "budget_status": kpi.budget_status(F.col("avg_budget_utilization"), settings),
            "opportunity_score": kpi.rounded(kpi.market_opportunity_score(budget, rank, market), 1),
            "total_lost_share": kpi.total_lost_share(budget, rank),
            "calculated_market_share": F.when(
                market > 0, kpi.rounded(kpi.ratio(F.col("total_impressions"), market) * 100, 2)
            ),
        }
    )


def _selection(
    analysis_type: str, min_spend_threshold: float, settings: Settings
) -> tuple[Column, str, int]:
    """Which campaigns an analysis keeps, what it ranks them by (most first), and how many it
    shows."""
    actionable = settings.actionable_lost_share
    by_score = "opportunity_score"
    if params.choice(analysis_type, ANALYSIS_TYPES, "analysis_type") == "budget_opportunities":
        keep = (F.col("weighted_budget_lost") >= actionable) & F.col("budget_status").isin(
            "CONSTRAINED", "BALANCED"
        )
        return keep, "additional_budget_needed", settings.budget_campaigns
    if analysis_type == "rank_opportunities":
        keep = (F.col("weighted_rank_lost") >= actionable) & F.col("opportunity_type").isin(
            "RANK_OPPORTUNITY", "RANK_IMPROVEMENT"
        )
        return keep, "potential_clicks_from_rank", settings.rank_campaigns
    if analysis_type == "regional_comparison":
        keep = F.col("total_spend") >= effective_min_spend(min_spend_threshold) * 2
        return keep, by_score, settings.regional_campaigns
    return F.col("total_lost_share") >= actionable / 2, by_score, settings.overview_campaigns


def ranked(
    campaigns: DataFrame,
    analysis_type: str = "overview",
    min_spend_threshold: float = 500,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Every campaign the analysis keeps, with its rank. Reports only need the first
    few and take ``limited``, which sorts no more than those."""
    keep, order, _ = _selection(analysis_type, min_spend_threshold, settings)
    return global_rank(campaigns.where(keep), [f"-{order}", *_KEYS], "analysis_rank")


def limited(
    campaigns: DataFrame,
    analysis_type: str = "overview",
    min_spend_threshold: float = 500,
    settings: Settings = SETTINGS,
) -> DataFrame:
    keep, order, count = _selection(analysis_type, min_spend_threshold, settings)
    return top_k(campaigns.where(keep), [F.desc(order), *ascending(*_KEYS)], count, "analysis_rank")


def _high_opportunity(settings: Settings) -> Column:
    return F.col("total_lost_share") >= settings.high_lost_share


def regional(shown: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Regions of the campaigns shown."""

    def share(name: str, weight: str) -> Column:
        return kpi.weighted_mean(F.col(name), F.col(weight))

    spend, conversions = F.sum("total_spend"), F.sum("total_conversions")
    return shown.groupBy("region").agg(
        F.count("*").alias("campaign_count"),
        spend.alias("region_spend"),
        conversions.alias("region_conversions"),
        kpi.cpa(spend, conversions).alias("region_cpa"),
        share("weighted_impression_share", "total_impressions").alias("region_impression_share"),
        share("weighted_budget_lost", "total_market_size").alias("region_budget_lost"),
        share("weighted_rank_lost", "total_market_size").alias("region_rank_lost"),
        F.sum("additional_budget_needed").alias("total_additional_budget"),
        F.sum("potential_clicks_from_rank").alias("total_potential_clicks"),
        kpi.mean(F.col("opportunity_score")).alias("avg_opportunity_score"),
        kpi.count_if(F.col("opportunity_type") == "OPTIMIZED").alias("optimized_campaigns"),
        kpi.count_if(_high_opportunity(settings)).alias("high_opportunity_campaigns"),
    )


def overall(shown: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row over the campaigns shown."""
    kind = F.col("opportunity_type")
    spend, conversions = F.sum("total_spend"), F.sum("total_conversions")
    actionable = F.col("total_lost_share") >= settings.actionable_lost_share
    return shown.agg(
        F.count("*").alias("total_campaigns_analyzed"),
        spend.alias("total_spend_analyzed"),
        conversions.alias("total_conversions_analyzed"),
        kpi.cpa(spend, conversions).alias("overall_cpa"),
        kpi.count_if(kind == "OPTIMIZED").alias("optimized_campaigns"),
        kpi.count_if(_high_opportunity(settings)).alias("high_opportunity_count"),
        kpi.count_if(actionable).alias("actionable_opportunity_count"),
        kpi.count_if(kind == "BUDGET_OPPORTUNITY").alias("budget_opportunities"),
        kpi.count_if(kind == "RANK_OPPORTUNITY").alias("rank_opportunities"),
        F.sum("additional_budget_needed").alias("total_budget_opportunity"),
        F.sum("potential_clicks_from_rank").alias("total_rank_opportunity"),
        kpi.mean(F.col("opportunity_score")).alias("average_opportunity_score"),
    )


def results(shown: DataFrame) -> DataFrame:
    """The campaigns shown, by score whatever they were ranked by."""
    order = [F.desc("opportunity_score"), F.asc("analysis_rank")]

    def rounded(column: str, places: int, name: str) -> Column:
        return kpi.rounded(F.col(column), places).alias(name)

    return numbered(shown, order).select(
        "position",
        F.col("campaign").alias("campaign_name"),
        "region",
        "campaign_type",
        "campaign_category",
        "funnel_stage",
        "is_brand_campaign",
        rounded("total_spend", 2, "spend"),
        F.col("total_conversions").alias("conversions"),
        rounded("blended_cpa", 2, "cpa"),
        rounded("weighted_impression_share", 1, "impression_share_pct"),
        rounded("weighted_top_impression_share", 1, "top_impression_share_pct"),
        rounded("weighted_absolute_top_share", 1, "absolute_top_share_pct"),
        rounded("weighted_budget_lost", 1, "budget_lost_pct"),
        rounded("weighted_rank_lost", 1, "rank_lost_pct"),
        rounded("total_lost_share", 1, "total_lost_share_pct"),
        rounded("avg_budget_utilization", 1, "budget_utilization_pct"),
        "opportunity_type",
        "budget_status",
        "opportunity_score",
        F.col("primary_market_position").alias("market_position"),
        F.col("primary_diagnosis").alias("performance_diagnosis"),
        rounded("additional_budget_needed", 2, "additional_budget_needed"),
        "potential_clicks_from_rank",
        rounded("avg_wow_change", 1, "wow_change_pct"),
    )


def regional_section(regions: DataFrame) -> DataFrame:
    order = [F.desc("region_spend"), F.asc_nulls_first("region")]
    return numbered(regions, order).select(
        "position",
        "region",
        "campaign_count",
        kpi.rounded(F.col("region_spend"), 2).alias("total_spend"),
        F.col("region_conversions").alias("total_conversions"),
        kpi.rounded(F.col("region_cpa"), 2).alias("regional_cpa"),
        kpi.rounded(F.col("region_impression_share"), 1).alias("avg_impression_share_pct"),
        kpi.rounded(F.col("region_budget_lost"), 1).alias("budget_lost_pct"),
        kpi.rounded(F.col("region_rank_lost"), 1).alias("rank_lost_pct"),
        kpi.rounded(F.col("total_additional_budget"), 2).alias("total_budget_opportunity"),
        "total_potential_clicks",
        kpi.rounded(F.col("avg_opportunity_score"), 1).alias("avg_opportunity_score"),
        "optimized_campaigns",
        "high_opportunity_campaigns",
    )


def _summary_section(totals: DataFrame, header: dict) -> DataFrame:
    def col(name: str, places: int | None = None) -> Column:
        return F.col(name) if places is None else kpi.rounded(F.col(name), places)

    optimized = col("optimized_campaigns")
    summary = {
        **header,
        "total_campaigns": col("total_campaigns_analyzed"),
        "total_spend": col("total_spend_analyzed", 2),
        "total_conversions": col("total_conversions_analyzed"),
        "overall_cpa": col("overall_cpa", 2),
        "performance_distribution": sections.json_struct(
            {
                "optimized_campaigns": optimized,
                "high_opportunity_campaigns": col("high_opportunity_count"),
                "actionable_opportunities": col("actionable_opportunity_count"),
            }
        ),
        "opportunity_breakdown": sections.json_struct(
            {
                "budget_constrained": col("budget_opportunities"),
                "rank_improvement_needed": col("rank_opportunities"),
                "already_optimized": optimized,
            }
        ),
        "total_opportunity_value": sections.json_struct(
            {
                "additional_budget_needed": col("total_budget_opportunity", 2),
                "potential_clicks_from_rank": col("total_rank_opportunity"),
                "average_opportunity_score": col("average_opportunity_score", 1),
            }
        ),
    }
    return totals.select(*sections.section("ANALYSIS_SUMMARY", sections.json_object(summary)))


def report(
    facts: DataFrame,
    as_of: date,
    analysis_type: str = "overview",
    date_range: str = "14d",
    regions: Sequence[str] = DEFAULT_COUNTRIES,
    include_brand_campaigns: bool = True,
    min_spend_threshold: float = 500,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """The packed report. Totals and regions are those of the campaigns shown."""
    campaigns = base(
        facts, as_of, date_range, regions, include_brand_campaigns, min_spend_threshold, settings
    )
    shown = shared(
        limited(classified(campaigns, settings), analysis_type, min_spend_threshold, settings)
    )
    header = {
        "analysis_type": analysis_type,
        "analysis_period": params.window_label(date_range, periods.range_days(date_range)),
        "regions_analyzed": params.names(regions, "regions"),
        "include_brand_campaigns": include_brand_campaigns,
        "min_spend_threshold": effective_min_spend(min_spend_threshold),
    }
    packed = [
        _summary_section(overall(shown, settings), header),
        sections.pack(
            f"{analysis_type.upper()}_RESULTS",
            "campaigns",
            sections.cut(results(shown), campaign_name=80),
            {"analysis_focus": analysis_type},
        ),
    ]
    if analysis_type in ("overview", "regional_comparison"):
        packed.append(
            sections.pack(
                "REGIONAL_INSIGHTS",
                "regional_performance",
                regional_section(regional(shown, settings)),
            )
        )
    return released_with(sections.report(packed), shown)
