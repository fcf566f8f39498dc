"""Campaign analysis: campaigns found by name, compared with the period before.

A campaign id may appear under several names, platforms and countries. Every such
appearance that matches is a row of the result and carries the totals of the whole
id, so an id with m matches counts m times in sums over the rows; in the comparison
period the sums themselves are m times the id's totals. Ratios are unaffected.

The facts are aggregated to one row per appearance in one scan, and the totals per id
are a window over those rows. The fan-out of facts by matches is never built.
"""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.functions import kpi, periods, text
from spendscope.plans import params, sections
from spendscope.plans.materialize import released_with, shared
from spendscope.plans.ranking import ascending, global_rank, top_k
from spendscope.settings import SETTINGS, Settings
from spendscope.sources.schemas import require_columns

_KEYS = ["campaign_id", "campaign", "platform", "country"]
_METRICS = ["spend", "conversions", "clicks", "impressions"]


def matches(
    facts: DataFrame,
    as_of: date,
    campaign_names: Sequence[str],
    comparison_period: str = "week_over_week",
    names: DataFrame | None = None,
) -> DataFrame:
    """Distinct appearances with spend in either period whose name holds a term. ``names``, if
    given, are those of ``matched_names``."""
    _, total_days = periods.period_days(comparison_period)
    terms = params.names(campaign_names, "campaign_names")
    spending = (
        require_columns(facts, ["date", *_KEYS, "spend"])
        .where(periods.current(as_of, total_days))
        .where(F.col("spend") > 0)
    )
    if names is not None:
        return spending.select(*_KEYS).distinct().join(names, "campaign", "left_semi").select(*_KEYS)
    return spending.where(text.contains_any(F.col("campaign"), terms)).select(*_KEYS).distinct()


def matched_names(
    facts: DataFrame,
    as_of: date,
    campaign_names: Sequence[str],
    comparison_period: str = "week_over_week",
) -> DataFrame:
    """The distinct names (``campaign``) in either period that hold a term, to be passed on as
    ``names`` where there are many terms: each name is then matched once, by a dictionary of
    the terms, and the aggregated rows are joined with the names found."""
    _, total_days = periods.period_days(comparison_period)
    in_window = require_columns(facts, ["date", "campaign"]).where(periods.current(as_of, total_days))
    return text.names_with_any(in_window, "campaign", params.names(campaign_names, "campaign_names"))


def matched_ids(
    facts: DataFrame,
    as_of: date,
    campaign_names: Sequence[str],
    comparison_period: str = "week_over_week",
    at_most: int = 10_000,
    names: DataFrame | None = None,
) -> list[str] | None:
    """The ids of all matches, to be passed on as ``ids``; None if there are more than
    ``at_most``. Runs a job that reads names and spend only.

    With ``ids`` the facts of other campaigns are filtered at the scan, before they are
    aggregated: row groups are skipped by their least and greatest id, and buckets of a
    bucketed table by the ids themselves.
    """
    found = (
        matches(facts, as_of, campaign_names, comparison_period, names)
        .where(F.col("campaign_id").isNotNull())
        .select("campaign_id").distinct().limit(at_most + 1).collect()
    )
    return sorted(r["campaign_id"] for r in found) if len(found) <= at_most else None


def _period_sums(as_of: date, comparison_period: str) -> dict[str, Column]:
    current_days, _ = periods.period_days(comparison_period)
    in_current = periods.current(as_of, current_days)
    conditions = {"current": in_current, "comparison": ~in_current}
    return {
        **{f"{p}_rows": kpi.count_if(inside) for p, inside in conditions.items()},
        **{
            f"{m}_{p}": F.sum(F.when(inside, F.col(m)))
            for p, inside in conditions.items()
            for m in _METRICS
        },
    }


def _matched_totals(
    facts: DataFrame,
    as_of: date,
    campaign_names: Sequence[str],
    comparison_period: str,
    ids: Sequence[str] | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Matching appearances with both periods' totals of their campaign id."""
    require_columns(facts, ["date", *_KEYS, *_METRICS])
    if ids is not None:
        facts = facts.where(text.in_list(F.col("campaign_id"), ids))
    _, total_days = periods.period_days(comparison_period)
    sums = _period_sums(as_of, comparison_period)
    of_id = Window.partitionBy("campaign_id")
    totals = (
        facts.where(periods.current(as_of, total_days) & F.col("campaign_id").isNotNull())
        .groupBy(*_KEYS)
        .agg(
            kpi.count_if(F.col("spend") > 0).alias("spending_rows"),
            *[total.alias(name) for name, total in sums.items()],
        )
        .select(*_KEYS, "spending_rows", *[F.sum(c).over(of_id).alias(c) for c in sums])
        .where(F.col("spending_rows") > 0)
        .drop("spending_rows")
    )
    if names is not None:
        return totals.join(names, "campaign", "left_semi")
    return totals.where(text.contains_any(F.col("campaign"), params.names(campaign_names, "campaign_names")))


def _kpis(period: str):
    spend, conversions, clicks, impressions = (F.col(f"{m}_{period}") for m in _METRICS)
    return [
        spend,
        conversions,
        kpi.cpa(spend, conversions).alias(f"cpa_{period}"),
        kpi.ctr(clicks, impressions).alias(f"ctr_{period}"),
        kpi.cvr(conversions, clicks).alias(f"cvr_{period}"),
    ]


def current_period(
    facts: DataFrame,
    as_of: date,
    campaign_names: Sequence[str],
    comparison_period: str = "week_over_week",
) -> DataFrame:
    """Every match with the current totals of its campaign id."""
    return (
        _matched_totals(facts, as_of, campaign_names, comparison_period)
        .where(F.col("current_rows") > 0)
        .select(*_KEYS, *_kpis("current"))
    )


def comparison_period(
    facts: DataFrame,
    as_of: date,
    campaign_names: Sequence[str],
    comparison_period: str = "week_over_week",
) -> DataFrame:
    """One row per matched campaign id; sums are taken once per match."""
    totals = [f"{m}_comparison" for m in _METRICS]
    return (
        _matched_totals(facts, as_of, campaign_names, comparison_period)
        .where(F.col("comparison_rows") > 0)
        .groupBy("campaign_id")
        .agg(*[F.sum(c).alias(c) for c in totals])
        .select("campaign_id", *_kpis("comparison"))
    )


def performance(
    facts: DataFrame,
    as_of: date,
    campaign_names: Sequence[str],
    comparison_period: str = "week_over_week",
    settings: Settings = SETTINGS,
    ids: Sequence[str] | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Matches with both periods, the changes between them and a CPA rating. ``ids`` and
    ``names``, if given, are those of ``matched_ids`` and ``matched_names``."""
    of_id = Window.partitionBy("campaign_id")
    per_match = [F.sum(f"{m}_comparison").over(of_id).alias(f"{m}_comparison") for m in _METRICS]
    both = (
        _matched_totals(facts, as_of, campaign_names, comparison_period, ids, names)
        .select(*_KEYS, "current_rows", *[f"{m}_current" for m in _METRICS], *per_match)
        .where(F.col("current_rows") > 0)
        .select(*_KEYS, *_kpis("current"), *_kpis("comparison"))
    )
    changes = {
        f"{k}_change_pct": kpi.pct_change(F.col(f"{k}_current"), F.col(f"{k}_comparison"))
        for k in ("cpa", "ctr", "cvr")
    }
    return both.withColumns(
        {**changes, "performance_rating": kpi.performance_rating(F.col("cpa_current"), settings)}
    )


def executive_summary(performance: DataFrame) -> DataFrame:
    """One row over all matches."""
    rating, platform = F.col("performance_rating"), F.col("platform")
    counts = {
        "excellent": rating == "EXCELLENT",
        "good": rating == "GOOD",
        "acceptable": rating == "ACCEPTABLE",
        "needs_attention": rating == "NEEDS_ATTENTION",
        "meta": platform == "Meta",
        "google": platform == "Google",
        "tiktok": platform == "tiktok",
        "other": ~platform.isin("Meta", "Google", "tiktok"),
    }
    spend, conversions = F.sum("spend_current"), F.sum("conversions_current")
    return performance.agg(
        F.count("*").alias("total_campaigns"),
        kpi.rounded(spend, 2).alias("total_spend"),
        conversions.alias("total_conversions"),
        kpi.rounded(kpi.cpa(spend, conversions), 2).alias("blended_cpa"),
        *[kpi.count_if(condition).alias(name) for name, condition in counts.items()],
    )


def problems(performance: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Badly rated matches, and big spenders with a high CPA. Any number of rows."""
    costly = (F.col("spend_current") > settings.problem_min_spend) & (
        F.col("cpa_current") > settings.problem_min_cpa
    )
    return performance.where((F.col("performance_rating") == "NEEDS_ATTENTION") | costly).select(
        *_KEYS,
        "spend_current",
        F.col("campaign").alias("campaign_name"),
        kpi.rounded(F.col("spend_current"), 2).alias("current_spend"),
        F.col("conversions_current").alias("current_conversions"),
        kpi.rounded(F.col("cpa_current"), 2).alias("current_cpa"),
        kpi.rounded(F.coalesce(F.col("cpa_comparison"), F.lit(0.0)), 2).alias("comparison_cpa"),
        _change_or_zero().alias("cpa_change_pct"),
        "performance_rating",
    )


def top_performers(performance: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    good = performance.where(F.col("performance_rating").isin("EXCELLENT", "GOOD")).where(
        F.col("spend_current") >= settings.top_performer_min_spend
    )
    return top_k(good, [F.desc("spend_current"), *ascending(*_KEYS)], settings.top_performers).select(
        "position",
        F.col("campaign").alias("campaign_name"),
        "platform",
        "country",
        kpi.rounded(F.col("spend_current"), 2).alias("spend"),
        F.col("conversions_current").alias("conversions"),
        kpi.rounded(F.col("cpa_current"), 2).alias("cpa"),
        _change_or_zero().alias("cpa_change_pct"),
    )


def _change_or_zero():
    return F.coalesce(F.col("cpa_change_pct"), F.lit(0).cast("decimal(2,1)"))


def match_counts(matched: DataFrame) -> DataFrame:
    """Matches per campaign id, from ``matches`` or ``performance``."""
    return matched.groupBy("campaign_id").agg(F.count("*").alias("match_count"))


def creatives(
    facts: DataFrame,
    as_of: date,
    counts: DataFrame,
    comparison_period: str = "week_over_week",
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Cheapest Meta creatives of the matched campaigns; spend and conversions count
    once per match of their campaign. The ads are aggregated before the join with the
    matches, which adaptive execution broadcasts if their measured size allows."""
    current_days, _ = periods.period_days(comparison_period)
    spend, conversions = F.col("creative_spend"), F.col("creative_conversions")
    ads = (
        require_columns(facts, ["date", "platform", "campaign_id", "ad_name", "spend", "conversions"])
        .where(periods.current(as_of, current_days))
        .where((F.col("platform") == "Meta") & F.col("ad_name").isNotNull())
        .groupBy("campaign_id", "ad_name")
        .agg(*[F.sum(m).alias(m) for m in ("spend", "conversions")])
        .join(counts, "campaign_id")
        .select(
            "ad_name",
            "campaign_id",
            (F.col("spend") * F.col("match_count")).alias("creative_spend"),
            (F.col("conversions") * F.col("match_count")).alias("creative_conversions"),
        )
        .where(spend >= settings.campaign_creative_min_spend)
        .where(conversions >= settings.campaign_creative_min_conversions)
        .withColumn("creative_cpa", kpi.cpa(spend, conversions))
    )
    order = [F.asc_nulls_first("creative_cpa"), F.asc("ad_name"), F.asc("campaign_id")]
    first_part = F.get(F.split(F.col("ad_name"), text.NAME_SEPARATOR), F.lit(0))
    return top_k(ads, order, settings.campaign_creatives).select(
        "position",
        "ad_name",
        first_part.alias("creative_concept"),
        kpi.rounded(spend, 2).alias("spend"),
        conversions.alias("conversions"),
        kpi.rounded(F.col("creative_cpa"), 2).alias("cpa"),
    )


def report(
    facts: DataFrame,
    as_of: date,
    campaign_names: Sequence[str],
    comparison_period: str = "week_over_week",
    include_creatives: bool = False,
    settings: Settings = SETTINGS,
    items_per_row: int = sections.ITEMS_PER_ROW,
    ids: Sequence[str] | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """The packed report: one scan for the matches and their totals and, if asked for,
    one for their creatives. Problem campaigns come in parts of ``items_per_row``. ``ids`` and
    ``names``, if given, are those of ``matched_ids`` and ``matched_names``; names cost a scan of
    their column."""
    matched = shared(performance(facts, as_of, campaign_names, comparison_period, settings, ids, names))
    kept: list[DataFrame] = []
    current_days, _ = periods.period_days(comparison_period)
    totals = ("total_campaigns", "total_spend", "total_conversions", "blended_cpa")
    summary = executive_summary(matched).select(
        *sections.section(
            "EXECUTIVE_SUMMARY",
            sections.json_object(
                {
                    "analysis_type": comparison_period,
                    "search_terms": params.names(campaign_names, "campaign_names"),
                    "period_days": current_days,
                    **{c: F.col(c) for c in totals},
                    "performance_breakdown": F.struct(
                        "excellent", "good", "acceptable", "needs_attention"
                    ),
                    "platform_breakdown": F.struct("meta", "google", "tiktok", "other"),
                }
            ),
        )
    )
    problem_columns = [
        "campaign_name", "platform", "country", "current_spend", "current_conversions",
        "current_cpa", "comparison_cpa", "cpa_change_pct", "performance_rating",
    ]
    packed = [
        summary,
        sections.pack_parts(
            "PROBLEM_CAMPAIGNS",
            "campaigns_needing_attention",
            global_rank(
                sections.cut(problems(matched, settings), campaign_name=80),
                ["-spend_current", *_KEYS],
                kept=kept,
            ),
            items_per_row=items_per_row,
            columns=problem_columns,
        ),
        sections.pack(
            "TOP_PERFORMERS",
            "excellent_campaigns",
            sections.cut(top_performers(matched, settings), campaign_name=80),
        ),
    ]
    if include_creatives:
        # a creative with current rows belongs to a campaign with current rows, so
        # counting the shared matches is enough
        ads = sections.cut(
            creatives(facts, as_of, match_counts(matched), comparison_period, settings),
            ad_name=100, creative_concept=50,
        )
        note = {"note": "Meta creative performance analysis included"}
        packed.append(sections.pack("CREATIVE_ANALYSIS", "top_creatives", ads, note))
    return released_with(sections.report(packed), matched, *kept)
