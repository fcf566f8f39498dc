"""Creative analysis: Meta ads and the concepts in their names."""

from __future__ import annotations

from datetime import date
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.functions import kpi, periods, text
from spendscope.plans import params, sections
from spendscope.plans.materialize import released_with, shared
from spendscope.plans.ranking import ascending, numbered, top_k
from spendscope.settings import DEFAULT_COUNTRIES, SETTINGS, Settings
from spendscope.sources.schemas import require_columns

SORT_KEYS = ("cpa", "spend", "conversions")
_COLUMNS = ["date", "platform", "country", "ad_id", "ad_name", "spend", "conversions",
            "clicks", "impressions"]


def effective_min_spend(min_spend: float) -> float:
    return params.clamped(min_spend, 50, 10_000)


def name_parts(facts: DataFrame) -> DataFrame:
    """Adds concept, format and creator, read from the ad name."""
    name = F.col("ad_name")
    return facts.withColumns(
        {
            "creative_concept": text.creative_concept(name),
            "creative_format": text.creative_format(name),
            "creative_creator": text.creative_creator(name),
        }
    )


def data(
    facts: DataFrame,
    as_of: date,
    date_range: str = "14d",
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    min_spend: float = 300,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Meta ads per country with enough spend. The parts follow from the ad name, so
    they are read from it after the aggregation and stay out of the shuffle."""
    spend, conversions = F.sum("spend"), F.sum("conversions")
    ads = (
        require_columns(facts, _COLUMNS)
        .where(periods.current(as_of, periods.range_days(date_range)))
        .where(F.col("platform") == "Meta")
        .where(text.in_list(F.col("country"), params.names(countries, "countries")))
        .where(F.col("spend") > 0)
        .groupBy("ad_id", "ad_name", "country")
        .agg(
            spend.alias("total_spend"),
            conversions.alias("total_conversions"),
            kpi.cpa(spend, conversions).alias("cpa"),
            kpi.ctr(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
            kpi.cvr(conversions, F.sum("clicks")).alias("cvr"),
        )
        .where(F.col("total_spend") >= effective_min_spend(min_spend))
        .where(F.col("total_conversions") >= settings.creative_min_conversions)
    )
    return name_parts(ads)


def concept_summary(
    ads: DataFrame, min_spend: float = 300, settings: Settings = SETTINGS
) -> DataFrame:
    """Ads rolled up to concept; an ad counts once per country. Average rates are not
    weighted by volume."""
    spend, conversions = F.sum("total_spend"), F.sum("total_conversions")
    return (
        ads.groupBy("creative_concept")
        .agg(
            F.count("*").alias("ad_count"),
            spend.alias("concept_spend"),
            conversions.alias("concept_conversions"),
            kpi.cpa(spend, conversions).alias("concept_cpa"),
            F.avg("ctr").alias("avg_ctr"),
            F.avg("cvr").alias("avg_cvr"),
        )
        .withColumn("performance_tier", kpi.performance_rating(F.col("concept_cpa"), settings))
        .where(
            F.col("concept_spend")
            >= effective_min_spend(min_spend) * settings.concept_spend_multiplier
        )
    )


def top_ads(ads: DataFrame, sort_by: str = "cpa", settings: Settings = SETTINGS) -> DataFrame:
    order = {
        "cpa": F.asc_nulls_first("cpa"),
        "spend": F.desc_nulls_first("total_spend"),
        "conversions": F.desc_nulls_first("total_conversions"),
    }[params.choice(sort_by, SORT_KEYS, "sort_by")]
    ties = ascending("ad_id", "ad_name", "country")
    return top_k(ads, [order, *ties], settings.top_ads, "rank").select(
        "ad_name",
        F.col("creative_concept").alias("concept"),
        F.col("creative_format").alias("format"),
        F.col("creative_creator").alias("creator"),
        "country",
        kpi.rounded(F.col("total_spend"), 2).alias("spend"),
        F.col("total_conversions").alias("conversions"),
        kpi.rounded(F.col("cpa"), 2).alias("cpa"),
        kpi.rounded(F.col("ctr"), 2).alias("ctr"),
        kpi.rounded(F.col("cvr"), 2).alias("cvr"),
        "rank",
    )


def tier_distribution(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("performance_tier").agg(
        F.count("*").alias("concept_count"),
        F.sum("concept_spend").alias("tier_spend"),
        F.avg("concept_cpa").alias("avg_tier_cpa"),
    )


def top_concepts(concepts: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    order = [F.asc_nulls_first("concept_cpa"), F.asc("creative_concept")]
    return top_k(concepts, order, settings.top_concepts).select(
        "position",
        F.col("creative_concept").alias("concept"),
        "ad_count",
        kpi.rounded(F.col("concept_spend"), 2).alias("total_spend"),
        F.col("concept_conversions").alias("conversions"),
        kpi.rounded(F.col("concept_cpa"), 2).alias("cpa"),
        kpi.rounded(F.col("avg_ctr"), 2).alias("avg_ctr"),
        kpi.rounded(F.col("avg_cvr"), 2).alias("avg_cvr"),
        "performance_tier",
    )


def overview(
    ads: DataFrame,
    concepts: DataFrame,
    date_range: str = "14d",
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    min_spend: float = 300,
    sort_by: str = "cpa",
) -> DataFrame:
    """Parameters, counts and the spread over tiers (at most four), packed."""
    tiers = numbered(tier_distribution(concepts), [F.asc("performance_tier")]).select(
        "position",
        F.col("performance_tier").alias("tier"),
        "concept_count",
        kpi.rounded(F.col("tier_spend"), 2).alias("total_spend"),
        kpi.rounded(F.col("avg_tier_cpa"), 2).alias("avg_cpa"),
    )
    header = {
        "analysis_period": params.window_label(date_range, periods.range_days(date_range)),
        "countries_analyzed": params.names(countries, "countries"),
        "min_spend_threshold": effective_min_spend(min_spend),
        "sort_criteria": params.choice(sort_by, SORT_KEYS, "sort_by"),
        "total_creatives_analyzed": ads.agg(F.count("*")).scalar(),
        "total_concepts": concepts.agg(F.count("*")).scalar(),
    }
    return sections.pack("CREATIVE_OVERVIEW", "performance_distribution", tiers, header)


def report(
    facts: DataFrame,
    as_of: date,
    date_range: str = "14d",
    countries: Sequence[str] = DEFAULT_COUNTRIES,
    min_spend: float = 300,
    sort_by: str = "cpa",
    settings: Settings = SETTINGS,
) -> DataFrame:
    """The packed report: one scan of the facts, then sections of the ads kept."""
    ads = shared(data(facts, as_of, date_range, countries, min_spend, settings))
    concepts = concept_summary(ads, min_spend, settings)
    packed = sections.report(
        [
            overview(ads, concepts, date_range, countries, min_spend, sort_by),
            sections.pack(
                "TOP_CONCEPTS", "best_performing_concepts", top_concepts(concepts, settings)
            ),
            sections.pack(
                "TOP_INDIVIDUAL_ADS",
                "top_performers",
                sections.cut(top_ads(ads, sort_by, settings), ad_name=120).withColumn(
                    "position", F.col("rank")
                ),
                {"sorting_note": f"Sorted by {sort_by}"},
            ),
        ]
    )
    return released_with(packed, ads)
