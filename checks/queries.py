"""Every operator as a query over the given tables, with the SQL to check it."""

from __future__ import annotations

from collections.abc import Callable
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import oracles as sql
from spendscope.functions import kpi, pivots
from spendscope.operators import adhoc, anomaly, campaign, creative, impression, regional, weekly
from spendscope.settings import SENSITIVITY
from spendscope.sources import derived, reports, rollup, scratch

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = derived.AS_OF
TERMS = ["grow_c", "50%"]
ALLOWED_TABLES = ["warehouse.ads.blended_summary", "warehouse.ads.impression_share_report"]

_QUERIES: dict[str, Query] = {}
_BUILDS: dict[str, tuple] = {}
_ORACLES: dict[str, str] = {}
_MADE: dict[str, tuple] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def builds() -> dict[str, tuple]:
    """Per query: where its facts come from, and the query as a function of the facts."""
    return dict(_BUILDS)


def plain(df: DataFrame, averages: tuple[str, ...] = ()) -> DataFrame:
    """Decimals as double, and means of doubles at 6 places, for comparison."""

    def column(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if field.name in averages:
            value = kpi.rounded(value, 6)
        elif not isinstance(field.dataType, T.DecimalType):
            return value
        return value.cast("double").alias(field.name)

    return df.select([column(f) for f in df.schema])


def _register(name: str, source, build, oracle: str | None, averages: tuple[str, ...] = ()) -> None:
    _MADE[name] = (source, build, averages)
    _BUILDS[name] = (source, lambda facts: plain(build(facts), averages))
    _QUERIES[name] = lambda spark, sf_dir: plain(build(source(spark, sf_dir)), averages)
    if oracle:
        _ORACLES[name] = oracle


def _facts(name: str, build, oracle: str, averages: tuple[str, ...] = ()) -> None:
    _register(name, derived.blended_summary, build, oracle, averages)


def _shares(name: str, build, oracle: str, averages: tuple[str, ...] = ()) -> None:
    _register(name, derived.impression_share_report, build, oracle, averages)


# ---------------------------------------------------------------- other facts


def _of(source, change, names: list[str]) -> None:
    """Queries once more, over facts of another source."""
    for name in names:
        _, build, averages = _MADE[name]
        suffix = source.__name__.rpartition("_summary_")[2].rpartition("_report_")[2]
        _register(f"{name}_{suffix}", source, build, change(_ORACLES[name]), averages)


# ---------------------------------------------------------------- weekly

_facts("weekly_base", lambda f: weekly.base(f, AS_OF), sql.weekly(sql.doubles("base", "total_spend")))
_facts("weekly_base_30d", lambda f: weekly.base(f, AS_OF, "30d", ["Meta", "Bing"], ["US", "CA", "NZ"]),
       sql.weekly(sql.doubles("base", "total_spend"), 30, ("Meta", "Bing"), ("US", "CA", "NZ")))
_facts("weekly_platform_summary", lambda f: weekly.platform_summary(weekly.base(f, AS_OF)),
       sql.weekly(sql.doubles("platforms", "platform_spend")))
_facts("weekly_platform_overview", lambda f: weekly.platform_overview(weekly.base(f, AS_OF)),
       sql.weekly(sql.doubles("platform_overview", "spend cpa vs_target_pct")))
_facts("weekly_regional_summary", lambda f: weekly.regional_summary(weekly.base(f, AS_OF)),
       sql.weekly(sql.doubles("countries", "country_spend")))
_facts("weekly_regional_overview", lambda f: weekly.regional_overview(weekly.base(f, AS_OF)),
       sql.weekly(sql.doubles("regional_overview", "spend cpa")))
_facts("weekly_top_issues", lambda f: weekly.top_issues(weekly.base(f, AS_OF)),
       sql.weekly(sql.doubles("issues", "current_cpa overspend_pct financial_impact")))
_facts("weekly_scale_opportunities", lambda f: weekly.scale_opportunities(weekly.base(f, AS_OF)),
       sql.weekly(sql.doubles("opportunities", "current_cpa efficiency_margin current_spend")))
_facts("weekly_report", lambda f: weekly.report(f, AS_OF), sql.weekly_report())
_facts("weekly_report_30d", lambda f: weekly.report(f, AS_OF, "30d", ["Google", "Bing"], ["US", "NZ"]),
       sql.weekly_report("30d", 30, ("Google", "Bing"), ("US", "NZ")))
_facts("weekly_report_empty", lambda f: weekly.report(f, AS_OF, countries=["Nowhere"]),
       sql.weekly_report(countries=("Nowhere",)))

# ---------------------------------------------------------------- campaign

_PERF = "spend_current spend_comparison cpa_change_pct ctr_change_pct cvr_change_pct"
_PROBLEMS = "spend_current current_spend current_cpa comparison_cpa cpa_change_pct"

_facts("campaign_matches", lambda f: campaign.matches(f, AS_OF, TERMS),
       sql.campaign("SELECT * FROM matches", TERMS))
_facts("campaign_current_period", lambda f: campaign.current_period(f, AS_OF, TERMS),
       sql.campaign(sql.doubles("current_period", "spend_current"), TERMS))
_facts("campaign_comparison_period", lambda f: campaign.comparison_period(f, AS_OF, TERMS),
       sql.campaign(sql.doubles("comparison_period", "spend_comparison"), TERMS))
_facts("campaign_performance", lambda f: campaign.performance(f, AS_OF, TERMS),
       sql.campaign(sql.doubles("performance", _PERF), TERMS))
_facts("campaign_performance_mom",
       lambda f: campaign.performance(f, AS_OF, ["podcast", "RETARGET"], "month_over_month"),
       sql.campaign(sql.doubles("performance", _PERF), ("podcast", "RETARGET"), 30, 60))
_facts("campaign_executive_summary",
       lambda f: campaign.executive_summary(campaign.performance(f, AS_OF, TERMS)),
       sql.campaign(sql.doubles("summary", "total_spend blended_cpa"), TERMS))
_facts("campaign_problems", lambda f: campaign.problems(campaign.performance(f, AS_OF, TERMS)),
       sql.campaign(f"SELECT * EXCLUDE (position) FROM ({sql.doubles('problems', _PROBLEMS)})", TERMS))
_facts("campaign_top_performers", lambda f: campaign.top_performers(campaign.performance(f, AS_OF, TERMS)),
       sql.campaign(sql.doubles("top_performers", "spend cpa cpa_change_pct"), TERMS))
_facts("campaign_creatives",
       lambda f: campaign.creatives(f, AS_OF, campaign.match_counts(campaign.matches(f, AS_OF, TERMS))),
       sql.campaign(sql.doubles("creatives", "spend cpa"), TERMS))
_facts("campaign_report", lambda f: campaign.report(f, AS_OF, TERMS), sql.campaign_report(TERMS))
_facts("campaign_report_parts", lambda f: campaign.report(f, AS_OF, TERMS, items_per_row=2),
       sql.campaign_report(TERMS, per_row=2))
_facts("campaign_report_creatives_mom",
       lambda f: campaign.report(f, AS_OF, ["a"], "month_over_month", True),
       sql.campaign_report(["a"], "month_over_month", 30, 60, True))

# ---------------------------------------------------------------- creative


def _ads(f: DataFrame) -> DataFrame:
    return creative.data(f, AS_OF)


def _concepts(f: DataFrame) -> DataFrame:
    return creative.concept_summary(_ads(f))


_PARTS = ["ad_name", "creative_concept", "creative_format", "creative_creator"]
_facts("creative_name_parts", lambda f: creative.name_parts(f).groupBy(*_PARTS).agg(F.count("*").alias("n")),
       sql.with_(sql.BLENDED, select=f"""
         SELECT {', '.join(_PARTS)}, COUNT(*) AS n
         FROM (SELECT ad_name, {sql.NAME_PARTS} FROM facts) GROUP BY ALL"""))
_facts("creative_data", _ads, sql.creative(sql.doubles("ads", "total_spend")))
_facts("creative_concept_summary", _concepts,
       sql.creative(sql.doubles("concepts", "concept_spend", "avg_ctr avg_cvr")), ("avg_ctr", "avg_cvr"))
for _key in creative.SORT_KEYS:
    _facts("creative_top_ads" if _key == "cpa" else f"creative_top_ads_by_{_key}",
           lambda f, key=_key: creative.top_ads(_ads(f), key),
           sql.creative(sql.doubles("top_ads", "spend cpa ctr cvr"), sort_by=_key))
_facts("creative_tier_distribution", lambda f: creative.tier_distribution(_concepts(f)),
       sql.creative(sql.doubles("tiers", "tier_spend", "avg_tier_cpa")), ("avg_tier_cpa",))
_facts("creative_top_concepts", lambda f: creative.top_concepts(_concepts(f)),
       sql.creative(sql.doubles("top_concepts", "total_spend cpa avg_ctr avg_cvr")))
_facts("creative_overview", lambda f: creative.overview(_ads(f), _concepts(f)),
       sql.creative(sql.creative_overview("14d", 14, sql.COUNTRIES, 300, "cpa")))
_facts("creative_report", lambda f: creative.report(f, AS_OF), sql.creative_report())
_facts("creative_report_30d", lambda f: creative.report(f, AS_OF, "30d", ["US", "CA"], 20, "spend"),
       sql.creative_report("30d", 30, ("US", "CA"), 50, "spend"))

# ---------------------------------------------------------------- regional


def _segments(f: DataFrame) -> DataFrame:
    return regional.performance(f, AS_OF)


def _countries(f: DataFrame) -> DataFrame:
    return regional.country_ranked(regional.country_summary(_segments(f)))


_SEGMENTS = "spend_current spend_previous cpa_change_pct"
_facts("regional_current", lambda f: regional.current(f, AS_OF),
       sql.regional(sql.doubles("current_period", "spend_current")))
_facts("regional_previous", lambda f: regional.previous(f, AS_OF),
       sql.regional(sql.doubles("previous_period", "spend_previous")))
_facts("regional_performance", _segments, sql.regional(sql.doubles("performance", _SEGMENTS)))
_facts("regional_performance_no_trends",
       lambda f: regional.performance(f, AS_OF, ["Bing"], "7d", False),
       sql.regional(sql.doubles("performance", _SEGMENTS), ("Bing",), 7, False))
_facts("regional_country_summary", lambda f: regional.country_summary(_segments(f)),
       sql.regional(sql.doubles("summary", "total_spend", "avg_ctr avg_cpa_change")),
       ("avg_ctr", "avg_cpa_change"))
_facts("regional_country_ranked", _countries,
       sql.regional(sql.doubles("ranked", "total_spend", "avg_ctr avg_cpa_change")),
       ("avg_ctr", "avg_cpa_change"))
_facts("regional_platform_country", lambda f: regional.platform_country(_segments(f)),
       sql.regional(sql.doubles("matrix", "platform_country_spend",
                                "platform_country_ctr platform_country_change")),
       ("platform_country_ctr", "platform_country_change"))
_facts("regional_country_section", lambda f: regional.country_section(_countries(f)),
       sql.regional(sql.doubles("country_items", "total_spend blended_cpa avg_ctr avg_cpa_change_pct")))
_facts("regional_platform_country_section",
       lambda f: regional.platform_country_section(regional.platform_country(_segments(f))),
       sql.regional(sql.doubles("matrix_items", "spend cpa ctr cpa_change_pct")))
_facts("regional_insights",
       lambda f: regional.insights(_countries(f)).withColumn(
           "needs_attention", F.array_join("needs_attention", ",")),
       sql.regional(f"""
         SELECT (SELECT country FROM ranked ORDER BY {sql.first('blended_cpa, country')} LIMIT 1)
             AS best_performing_country,
           (SELECT country FROM ranked ORDER BY total_spend DESC, country LIMIT 1) AS highest_spend_country,
           (SELECT country FROM ranked WHERE avg_cpa_change IS NOT NULL
            ORDER BY avg_cpa_change, country LIMIT 1) AS most_improved,
           (SELECT string_agg(country, ',' ORDER BY country) FROM ranked WHERE weak_segments >= 2)
             AS needs_attention,
           (SELECT COUNT(*) FROM ranked) AS total_countries_analyzed"""))
_facts("regional_report", lambda f: regional.report(f, AS_OF), sql.regional_report())
_facts("regional_report_platform_by_country",
       lambda f: regional.report(f, AS_OF, ["Google", "Bing"], "platform_by_country", "30d"),
       sql.regional_report(("Google", "Bing"), "platform_by_country", "30d", 30))
_facts("regional_report_parts",
       lambda f: regional.report(f, AS_OF, comparison_type="platform_by_country", items_per_row=2),
       sql.regional_report(kind="platform_by_country", per_row=2))
_facts("regional_report_no_trends",
       lambda f: regional.report(f, AS_OF, date_range="7d", include_trends=False),
       sql.regional_report(label="7d", days=7, trends=False))

# ---------------------------------------------------------------- anomaly


def _features(f: DataFrame, sensitivity: str = "medium") -> DataFrame:
    return anomaly.features(f, AS_OF, sensitivity)


def _top_campaigns(f: DataFrame) -> DataFrame:
    return anomaly.significant_campaigns(_features(f))


def _top_regions(f: DataFrame) -> DataFrame:
    return anomaly.significant_regions(anomaly.regional(_features(f)))


_FEATURES = "spend_current spend_comparison excess_cost"
_REGIONS = "total_spend_current total_spend_comparison total_excess_cost"
_facts("anomaly_current", lambda f: anomaly.current(f, AS_OF),
       sql.anomaly(sql.doubles("current_period", "spend_current")))
_facts("anomaly_comparison", lambda f: anomaly.comparison(f, AS_OF),
       sql.anomaly(sql.doubles("comparison_period", "spend_comparison")))
for _level in SENSITIVITY:
    _facts("anomaly_features" if _level == "medium" else f"anomaly_features_{_level}",
           lambda f, level=_level: _features(f, level),
           sql.anomaly(sql.doubles("features", _FEATURES), _level))
_facts("anomaly_regional", lambda f: anomaly.regional(_features(f)),
       sql.anomaly(sql.doubles("regions", _REGIONS)))
_facts("anomaly_significant_campaigns", _top_campaigns,
       sql.anomaly(sql.doubles("top_campaigns", _FEATURES)))
_facts("anomaly_campaign_section", lambda f: anomaly.campaign_section(_top_campaigns(f)),
       sql.anomaly(sql.doubles("campaign_items", "current_spend current_cpa cpa_change_pct ctr_change_pct "
                               "cvr_change_pct spend_change_pct excess_cost")))
_facts("anomaly_significant_regions", _top_regions, sql.anomaly(sql.doubles("top_regions", _REGIONS)))
_facts("anomaly_region_section", lambda f: anomaly.region_section(_top_regions(f)),
       sql.anomaly(sql.doubles("region_items", "total_spend_current blended_cpa_current "
                               "blended_cpa_comparison regional_cpa_change_pct total_excess_cost")))
_facts("anomaly_summary", lambda f: anomaly.summary(_top_campaigns(f), _top_regions(f)),
       sql.anomaly(sql.doubles("summary", "total_excess_cost")))
_facts("anomaly_report", lambda f: anomaly.report(f, AS_OF), sql.anomaly_report())
_facts("anomaly_report_high",
       lambda f: anomaly.report(f, AS_OF, "high", ["Meta", "Google"], ["US", "CA", "NZ"], 10),
       sql.anomaly_report("high", ("Meta", "Google"), ("US", "CA", "NZ"), 100))
_facts("anomaly_report_low", lambda f: anomaly.report(f, AS_OF, "low"), sql.anomaly_report("low"))

# ---------------------------------------------------------------- impression share


def _campaigns(i: DataFrame) -> DataFrame:
    return impression.classified(impression.base(i, AS_OF))


def _shown(i: DataFrame) -> DataFrame:
    return impression.limited(_campaigns(i))


_BASE = "total_spend additional_budget_needed"
_CLASSIFIED = f"{_BASE} opportunity_score calculated_market_share"
_shares("impression_base", lambda i: impression.base(i, AS_OF), sql.impression(sql.doubles("base", _BASE)))
_shares("impression_base_no_brand",
        lambda i: impression.base(i, AS_OF, "30d", ["US", "CA"], False, 1000),
        sql.impression(sql.doubles("base", _BASE), days=30, regions=("US", "CA"), brand=False, min_spend=1000))
_shares("impression_classified", _campaigns, sql.impression(sql.doubles("classified", _CLASSIFIED)))
for _kind in impression.ANALYSIS_TYPES:
    _suffix = "" if _kind == "overview" else f"_{_kind}"
    _shares(f"impression_ranked{_suffix}", lambda i, kind=_kind: impression.ranked(_campaigns(i), kind),
            sql.impression(sql.doubles("ranked", _CLASSIFIED), _kind))
    _shares(f"impression_limited{_suffix}", lambda i, kind=_kind: impression.limited(_campaigns(i), kind),
            sql.impression(sql.doubles("shown", _CLASSIFIED), _kind))
    _shares(f"impression_report{_suffix}", lambda i, kind=_kind: impression.report(i, AS_OF, kind),
            sql.impression_report(_kind))
_REGION_SHARES = ("region_impression_share", "region_budget_lost", "region_rank_lost")
_shares("impression_regional", lambda i: impression.regional(_shown(i)),
        sql.impression(sql.doubles("regions", "region_spend total_additional_budget",
                                   " ".join(_REGION_SHARES))), _REGION_SHARES)
_shares("impression_overall", lambda i: impression.overall(_shown(i)),
        sql.impression(sql.doubles("overall", "total_spend_analyzed total_budget_opportunity")))
_shares("impression_results", lambda i: impression.results(_shown(i)),
        sql.impression(sql.doubles(
            "result_items", "spend cpa impression_share_pct top_impression_share_pct absolute_top_share_pct "
            "budget_lost_pct rank_lost_pct total_lost_share_pct budget_utilization_pct opportunity_score "
            "additional_budget_needed wow_change_pct")))
_shares("impression_report_no_brand",
        lambda i: impression.report(i, AS_OF, "overview", "7d", ["US", "NZ"], False, 50),
        sql.impression_report("overview", "7d", 7, ("US", "NZ"), False, 100))

# ---------------------------------------------------------------- KPI functions, pivots

_LOST = ["budget_lost_impression_share_pct", "rank_lost_impression_share_pct"]


def _per_value(i: DataFrame, name: str, value, columns: list[str]) -> DataFrame:
    return i.withColumn(name, value).groupBy(*columns, name).agg(F.count("*").alias("n"))


def _per_value_sql(name: str, value: str, columns: list[str], cast: str = "") -> str:
    keys = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if "pct" in c else c for c in columns)
    return sql.with_(sql.SHARES, select=f"""
      SELECT {keys}, {value} AS {name}, COUNT(*) AS n FROM facts GROUP BY ALL""")


_shares("opportunity_type",
        lambda i: _per_value(i, "opportunity_type", kpi.opportunity_type(*map(F.col, _LOST)), _LOST),
        _per_value_sql("opportunity_type", sql.opportunity_type(*_LOST), _LOST))
_shares("budget_status",
        lambda i: _per_value(i, "budget_status", kpi.budget_status(F.col("budget_utilization_pct")),
                             ["budget_utilization_pct"]),
        _per_value_sql("budget_status", sql.budget_status("budget_utilization_pct"),
                       ["budget_utilization_pct"]))
_shares("total_lost_share",
        lambda i: _per_value(i, "total_lost_share", kpi.total_lost_share(*map(F.col, _LOST)), _LOST),
        _per_value_sql("total_lost_share", f"CAST({sql.lost(*_LOST)} AS DOUBLE)", _LOST))
_shares("market_opportunity_score",
        lambda i: _per_value(
            i, "score", kpi.market_opportunity_score(*map(F.col, _LOST), F.col("market_size_impressions")),
            [*_LOST, "market_size_impressions"]),
        _per_value_sql("score", sql.score(*_LOST, "market_size_impressions"),
                       [*_LOST, "market_size_impressions"]))


def _daily(f: DataFrame) -> DataFrame:
    return f.groupBy("platform", "country", "campaign_id", "date").agg(
        *[F.sum(m).alias(m) for m in ("spend", "conversions", "clicks", "impressions")])


def _daily_sql(select: str) -> str:
    return sql.with_(sql.BLENDED, f"""
      daily AS (SELECT platform, country, campaign_id, date, SUM(spend) AS spend,
        {sql.bigint('SUM(conversions)')} AS conversions, {sql.bigint('SUM(clicks)')} AS clicks,
        {sql.bigint('SUM(impressions)')} AS impressions FROM facts GROUP BY ALL)""", select=select)


_KEYS = ["platform", "country", "campaign_id", "date"]
_facts("kpi_ratios",
       lambda f: _daily(f).select(
           *_KEYS,
           kpi.cpa(F.col("spend"), F.col("conversions")).alias("cpa"),
           kpi.ctr(F.col("clicks"), F.col("impressions")).alias("ctr"),
           kpi.cvr(F.col("conversions"), F.col("clicks")).alias("cvr")),
       _daily_sql(f"""SELECT {', '.join(_KEYS)}, {sql.ratio('spend', 'conversions')} AS cpa,
           {sql.pct('clicks', 'impressions')} AS ctr, {sql.pct('conversions', 'clicks')} AS cvr FROM daily"""))
_facts("performance_rating",
       lambda f: _daily(f).select(
           *_KEYS, kpi.performance_rating(kpi.cpa(F.col("spend"), F.col("conversions"))).alias("rating")),
       _daily_sql(f"""SELECT {', '.join(_KEYS)}, {sql.rating(sql.ratio('spend', 'conversions'))} AS rating
           FROM daily"""))
_facts("target_cpa",
       lambda f: f.groupBy("platform").agg(F.count("*").alias("n")).select(
           "platform", "n", kpi.target_cpa(F.col("platform")).alias("target_cpa")),
       sql.with_(sql.BLENDED, select=f"""
         SELECT platform, COUNT(*) AS n, {sql.target()} AS target_cpa FROM facts GROUP BY platform"""))
_facts("scale_potential",
       lambda f: _daily(f).select(*_KEYS, "spend", kpi.scale_potential(F.col("spend")).alias("potential")),
       _daily_sql(f"""SELECT {', '.join(_KEYS)}, CAST(spend AS DOUBLE) AS spend,
           CAST(spend * CAST(CASE WHEN spend < 500 THEN 1.0 WHEN spend < 1500 THEN 0.5 ELSE 0.2 END
                             AS DECIMAL(4,2)) AS DOUBLE) AS potential FROM daily"""))
_facts("confidence_level",
       lambda f: _daily(f).select(
           *_KEYS, kpi.confidence_level(F.col("spend"), F.col("conversions"), SENSITIVITY["high"])
           .alias("confidence")),
       _daily_sql(f"""SELECT {', '.join(_KEYS)},
           CASE WHEN spend >= 1200 AND conversions >= 9 THEN 'HIGH'
                WHEN spend >= 600 AND conversions >= 6 THEN 'MEDIUM'
                WHEN spend >= 300 AND conversions >= 3 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence
           FROM daily"""))
_facts("excess_cost",
       lambda f: _daily(f).select(
           *_KEYS, kpi.excess_cost(F.col("spend"), F.col("conversions"), kpi.target_cpa(F.col("platform")))
           .alias("excess_cost")),
       _daily_sql(f"""SELECT {', '.join(_KEYS)},
           CAST(CASE WHEN {sql.ratio('spend', 'conversions')} > {sql.target()}
             THEN {sql.rnd(f"({sql.ratio('spend', 'conversions')} - {sql.target()}) * conversions", 6)}
             ELSE 0 END AS DOUBLE)
             AS excess_cost FROM daily"""))
_facts("pct_change",
       lambda f: _two_days(f).select(*_KEYS[:3], kpi.pct_change(
           F.col("now").cast("double"), F.col("before").cast("double")).alias("pct_change")),
       sql.with_(sql.BLENDED, f"""
         two AS (SELECT platform, country, campaign_id,
           SUM(CASE WHEN date = {sql.AS_OF} THEN spend END)::DOUBLE AS now,
           SUM(CASE WHEN date = {sql.AS_OF} - 1 THEN spend END)::DOUBLE AS before
         FROM facts GROUP BY ALL)""", select=f"""
         SELECT platform, country, campaign_id, CAST({sql.pct_change('now', 'before')} AS DOUBLE)
           AS pct_change FROM two"""))


def _two_days(f: DataFrame) -> DataFrame:
    def on(days: int):
        return F.sum(F.when(F.col("date") == F.date_sub(F.lit(AS_OF), days), F.col("spend")))

    return f.groupBy(*_KEYS[:3]).agg(on(0).alias("now"), on(1).alias("before"))


def _share_periods(i: DataFrame) -> DataFrame:
    now = F.col("date") >= F.date_sub(F.lit(AS_OF), 14)
    share = F.col("search_impression_share_pct")
    return i.groupBy("region", "campaign").agg(
        kpi.mean(F.when(now, share)).alias("current_share"),
        kpi.mean(F.when(~now, share)).alias("previous_share"))


_shares("impression_share_change",
        lambda i: _share_periods(i).withColumn(
            "change_pct", kpi.impression_share_change(F.col("current_share"), F.col("previous_share"))),
        sql.with_(sql.SHARES, f"""
          means AS (SELECT region, campaign,
            {sql.mean(f"CASE WHEN {sql.cur(14)} THEN search_impression_share_pct END")} AS current_share,
            {sql.mean(f"CASE WHEN NOT {sql.cur(14)} THEN search_impression_share_pct END")} AS previous_share
          FROM facts GROUP BY ALL)""", select=f"""
          SELECT *, CAST({sql.pct_change('current_share', 'previous_share')} AS DOUBLE) AS change_pct
          FROM means"""))

_PIVOT = ["Meta", "Google", "Bing", "Tik-Tok", "tiktok"]


def _pivot_sql(platform: str, metric: str) -> str:
    return f"SUM(CASE WHEN platform = '{platform}' THEN {metric} END)"


_facts("platform_pivot",
       lambda f: f.groupBy("country").agg(
           *pivots.platform_pivot("spend", _PIVOT), *pivots.platform_pivot("conversions", ["Meta"], 0)),
       sql.with_(sql.BLENDED, select=f"""
         SELECT country, {', '.join(
             f"CAST({sql.rnd(_pivot_sql(p, 'spend'), 2)} AS DOUBLE) AS {p.lower().replace('-', '_')}_spend"
             for p in _PIVOT)},
           CAST({sql.rnd(_pivot_sql('Meta', 'conversions'), 0)} AS DOUBLE) AS meta_conversions
         FROM facts GROUP BY country"""))
_facts("platform_cpa_pivot",
       lambda f: f.groupBy("country", "date").agg(*pivots.platform_cpa_pivot(_PIVOT)),
       sql.with_(sql.BLENDED, select=f"""
         SELECT country, date, {', '.join(
             f"CAST({sql.rnd(sql.ratio(_pivot_sql(p, 'spend'), _pivot_sql(p, 'conversions')), 2)} AS DOUBLE) "
             f"AS {p.lower().replace('-', '_')}_cpa" for p in _PIVOT)}
         FROM facts GROUP BY country, date"""))

# ---------------------------------------------------------------- ad-hoc

_WEEKLY_SPEND = sql.with_(sql.BLENDED, select="""
  SELECT CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS week, platform,
    CAST(SUM(spend) AS DOUBLE) AS weekly_spend
  FROM facts WHERE date >= DATE 'SINCE' AND date <= DATE '2024-03-31'
  GROUP BY 1, 2 ORDER BY 1, 2 NULLS FIRST""")
_facts("adhoc_weekly_platform_spend",
       lambda f: adhoc.weekly_platform_spend(f, date(2024, 1, 1), date(2024, 3, 31)),
       _WEEKLY_SPEND.replace("SINCE", "2024-01-01"))
_facts("adhoc_weekly_platform_spend_limit",
       lambda f: adhoc.weekly_platform_spend(f, date(2023, 11, 1), date(2024, 3, 31), 20),
       _WEEKLY_SPEND.replace("SINCE", "2023-11-01") + " LIMIT 20")
_facts("adhoc_weekly_platform_spend_all",
       lambda f: adhoc.weekly_platform_spend(f, date(2023, 11, 1), date(2024, 3, 31)),
       _WEEKLY_SPEND.replace("SINCE", "2023-11-01"))
_facts("adhoc_platform_comparison", lambda f: adhoc.platform_comparison(f, AS_OF),
       sql.with_(sql.BLENDED, select=f"""
         SELECT platform, CAST({sql.rnd('AVG(cpa)', 6)} AS DOUBLE) AS avg_cpa,
           {sql.bigint('SUM(conversions)')} AS total_conversions
         FROM facts WHERE {sql.cur(30)} GROUP BY platform
         ORDER BY AVG(cpa) NULLS FIRST, platform"""), ("avg_cpa",))
_shares("adhoc_visibility", lambda i: adhoc.visibility(i, AS_OF),
        sql.with_(sql.SHARES, select=f"""
          SELECT region, campaign_type, {sql.mean('search_impression_share_pct')} AS avg_impression_share,
            {sql.mean('budget_lost_impression_share_pct')} AS avg_budget_lost
          FROM facts WHERE {sql.cur(14)} GROUP BY 1, 2
          ORDER BY 3 DESC, region NULLS FIRST, campaign_type NULLS FIRST"""))
_OPPORTUNITY = ["budget_utilization_pct", "budget_lost_impression_share_pct",
                "rank_lost_impression_share_pct", "estimated_budget_needed_for_lost_impressions"]
_shares("adhoc_opportunity_rows", lambda i: adhoc.opportunity_rows(i, AS_OF),
        sql.with_(sql.SHARES, select=f"""
          SELECT campaign, region, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _OPPORTUNITY)}
          FROM facts f WHERE {sql.cur(7)} AND budget_lost_impression_share_pct > 20
          ORDER BY f.estimated_budget_needed_for_lost_impressions DESC, campaign NULLS FIRST,
            region NULLS FIRST, f.budget_utilization_pct NULLS FIRST,
            f.budget_lost_impression_share_pct, f.rank_lost_impression_share_pct NULLS FIRST LIMIT 10"""))


def _governed(f: DataFrame) -> DataFrame:
    f.createOrReplaceTempView("blended_summary")
    return adhoc.governed_sql(
        f.sparkSession,
        """WITH recent AS (SELECT * FROM `warehouse.ads.blended_summary` WHERE date >= DATE '2024-01-01')
           SELECT WEEK_START(date) AS week, platform, SUM(spend) AS spend,
                  SAFE_DIVIDE(SUM(spend), SUM(conversions)) AS cpa
           FROM recent GROUP BY week, platform ORDER BY week, platform LIMIT 500;""",
        aliases=dict(zip(ALLOWED_TABLES, ["blended_summary", "impression_share_report"])),
    )


_facts("governed_sql", _governed,
       sql.with_(sql.BLENDED, select=f"""
         SELECT CAST(date - CAST(dayofweek(date) AS INTEGER) AS DATE) AS week, platform,
           CAST(SUM(spend) AS DOUBLE) AS spend, {sql.ratio('SUM(spend)', 'SUM(conversions)')} AS cpa
         FROM facts WHERE date >= DATE '2024-01-01' GROUP BY 1, 2"""))


def _governed_shares(f: DataFrame) -> DataFrame:
    f.createOrReplaceTempView("impression_share_report")
    return adhoc.governed_sql(
        f.sparkSession,
        """SELECT region, campaign_type, COUNT(*) AS n, MAX(search_impression_share_pct) AS best,
                  CASE WHEN SUM(clicks) > 0 THEN 'warehouse.ads.impression_share_report' END AS src
           FROM warehouse.ads.impression_share_report GROUP BY region, campaign_type""",
        aliases=dict(zip(ALLOWED_TABLES, ["blended_summary", "impression_share_report"])),
    )


_shares("governed_sql_impressions", _governed_shares,
        sql.with_(sql.SHARES, select="""
          SELECT region, campaign_type, COUNT(*) AS n, CAST(MAX(search_impression_share_pct) AS DOUBLE) AS best,
            CASE WHEN SUM(clicks) > 0 THEN 'warehouse.ads.impression_share_report' END AS src
          FROM facts GROUP BY 1, 2"""))


def _governed_literals(f: DataFrame) -> DataFrame:
    f.createOrReplaceTempView("blended_summary")
    return adhoc.governed_sql(
        f.sparkSession,
        """SELECT campaign, 'UnresolvedRelation [foo, bar]' AS shown, 'Update 5; DROP TABLE x' AS words, COUNT(*) AS n
           FROM blended_summary WHERE campaign <> 'Update 5' AND campaign <> 'blended_summary'
           GROUP BY campaign""")


def _governed_texts(f: DataFrame, query: str) -> DataFrame:
    f.createOrReplaceTempView("blended_summary")
    return adhoc.governed_sql(f.sparkSession, query, aliases={ALLOWED_TABLES[0]: "blended_summary"})


_facts("governed_sql_literals", _governed_literals,
       sql.with_(sql.BLENDED, select="""
         SELECT campaign, 'UnresolvedRelation [foo, bar]' AS shown, 'Update 5; DROP TABLE x' AS words, COUNT(*) AS n
         FROM facts WHERE campaign <> 'Update 5' GROUP BY campaign"""))

# ---------------------------------------------------------------- query guard

# The words and patterns of the rules.

_VERBS = "DROP|CREATE|ALTER|INSERT|UPDATE|DELETE|TRUNCATE"
_SPACE = r"[\s\x0B\p{Z}\x{FEFF}]"


def _guard_sql(texts: str) -> str:
    def has(pattern: str) -> str:
        return f"regexp_matches(q, '{pattern}')"

    def named(value: str) -> str:
        return "(" + " OR ".join(f"contains({value}, '{t}')" for t in ALLOWED_TABLES) + ")"

    table = r"`[^`]+`\.`[^`]+`\.`[^`]+`|[\w-]+\.[\w-]+\.[\w-]+"
    return f"""
      WITH texts AS ({texts}),
      cleaned AS (SELECT id, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS q FROM texts),
      measured AS (SELECT *,
        length(q) + length(regexp_replace(q, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units,
        regexp_extract_all(q, '{table}') AS names FROM cleaned),
      ruled AS (SELECT id, CASE
        WHEN q IS NULL THEN 'NOT_A_STRING'
        WHEN units > 10000 THEN 'TOO_LONG'
        WHEN {has(rf'(?i);{_SPACE}*({_VERBS})')} OR contains(q, '--') OR {has(r'/\*[\s\S]*?\*/')}
          OR {has(r'(?i)\bxp_cmdshell\b')} OR {has(r'(?i)\bsp_executesql\b')} THEN 'DANGEROUS_PATTERN'
        WHEN {has(rf'(?i)\b({_VERBS})\b')} THEN 'WRITE_OPERATION'
        WHEN {has(r'(?i)\b(INFORMATION_SCHEMA|mysql|pg_|sys\.)\b')} THEN 'SYSTEM_SCHEMA'
        WHEN {has(r'(?i)\b(LOAD|OUTFILE|DUMPFILE|EXPORT)\b')} THEN 'FILE_OPERATION'
        WHEN len(list_filter(names, lambda t: NOT {named('t')})) > 0 THEN 'UNAUTHORIZED_TABLE'
        WHEN {has(r'(?i)\bJOIN\b')} AND len(names) > 1 THEN 'JOIN'
        WHEN NOT ({has(rf'(?i)\bLIMIT{_SPACE}+\d+\b')}
          OR {has(rf'(?i)\bCOUNT{_SPACE}*\({_SPACE}*[*\w]+{_SPACE}*\)')}
          OR {has(rf'(?i)\b(SUM|AVG|MAX|MIN|COUNT){_SPACE}*\(')}) THEN 'NO_LIMIT'
        WHEN NOT {named('q')} THEN 'NO_ALLOWED_TABLE'
        ELSE 'PASSED' END AS rule FROM measured)
      SELECT id, rule, CASE WHEN rule = 'PASSED' THEN 'PASS' ELSE 'REJECT' END AS verdict FROM ruled"""


def _audit(texts: DataFrame) -> DataFrame:
    return adhoc.query_guard_audit(texts, "text", ALLOWED_TABLES).select("id", "rule", "verdict")


def _given_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "concat('d', CAST(doc_id AS STRING)) AS id", "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(
        "concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id", "text")
    return documents.unionByName(turns)


_register("query_guard_audit", _given_texts, _audit, _guard_sql("""
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations"""))

# one query text per order; the expression means the same in both engines
_B, _S = ALLOWED_TABLES
_TEMPLATES = [
    f"'SELECT * FROM {_B} LIMIT ' || key",
    f"'SELECT * FROM `{_B}` WHERE id = ' || key",
    f"'select count(*) from {_S} where id = ' || key",
    f"'SELECT sum (spend) FROM `{_B}` WHERE id = ' || key",
    f"'SELECT 1 FROM {_B} LIMIT 1; drop table t' || key",
    f"'SELECT 1 FROM {_B} LIMIT 1 -- ' || key",
    f"'SELECT 1 /* ' || key || ' */ FROM {_B} LIMIT 1'",
    f"'Delete FROM {_B} WHERE id = ' || key",
    f"'SELECT updated_at FROM {_B} LIMIT ' || key",
    "'SELECT * FROM information_schema.tables LIMIT ' || key",
    f"'SELECT pg_ FROM {_B} LIMIT ' || key",
    f"'SELECT * FROM sys.x, {_B} LIMIT ' || key",
    f"'SELECT * FROM {_B} INTO OUTFILE ' || key",
    f"'SELECT * FROM other.ads.blended_summary LIMIT ' || key",
    f"'SELECT * FROM {_B}_x LIMIT ' || key",
    f"'SELECT * FROM {_B} a JOIN {_S} b ON a.id = b.id LIMIT ' || key",
    f"'SELECT * FROM {_B} a, {_S} b LIMIT ' || key",
    f"'SELECT * FROM `warehouse`.`ads`.`blended_summary` LIMIT ' || key",
    "'SELECT * FROM blended_summary LIMIT ' || key",
    f"repeat('SELECT ', 1500) || key || ' FROM {_B} LIMIT 1'",
    f"'  SELECT * FROM {_B} limit  ' || key || ' '",
    "CASE WHEN key <> '' THEN NULL ELSE key END",
]
_TEXT = "CASE o_orderkey % {n} {cases} END".format(
    n=len(_TEMPLATES), cases=" ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(_TEMPLATES)))


def _generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr("o_orderkey", "CAST(o_orderkey AS STRING) AS key").selectExpr(
        "key AS id", f"{_TEXT} AS text")


_register("query_guard_audit_sql_texts", _generated_texts, _audit, _guard_sql(
    f"SELECT key AS id, {_TEXT} AS text FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key FROM orders)"))

_facts("governed_sql_raw_literals", lambda f: _governed_texts(f, r"""
           SELECT r'\' AS a, 'warehouse.ads.blended_summary' AS b, platform, COUNT(*) AS n
           FROM warehouse.ads.blended_summary GROUP BY platform"""),
       sql.with_(sql.BLENDED, select=r"""
         SELECT '\' AS a, 'warehouse.ads.blended_summary' AS b, platform, COUNT(*) AS n FROM facts GROUP BY platform"""))
_facts("governed_sql_column_aliases", lambda f: _governed_texts(f, """
           WITH x AS (SELECT platform, spend FROM WAREHOUSE.ads.`blended_summary` WHERE spend > 0)
           SELECT platform AS `blended_summary`, SUM(spend) AS `warehouse.ads.blended_summary` FROM x GROUP BY platform"""),
       sql.with_(sql.BLENDED, select="""
         SELECT platform AS "blended_summary", CAST(SUM(spend) AS DOUBLE) AS "warehouse.ads.blended_summary"
         FROM facts WHERE spend > 0 GROUP BY platform"""))

# ---------------------------------------------------------------- sketches

_shares("impression_base_approximate", lambda i: impression.base(i, AS_OF, approximate=True),
        sql.impression(sql.doubles("base", _BASE)))
_shares("impression_modal_labels",
        lambda i: impression.modal_labels(impression.label_states(i), AS_OF),
        sql.with_(sql.SHARES, sql.modal_labels(["region"]), select=sql.MODAL_LABELS.format(keys="region")))
_shares("impression_modal_labels_stored",
        lambda i: impression.modal_labels(_stored(impression.label_states(i)), AS_OF, "30d", ["region", "campaign_type"]),
        sql.with_(sql.SHARES, sql.modal_labels(["region", "campaign_type"], 30),
                  select=sql.MODAL_LABELS.format(keys="region, campaign_type")))


def _stored(df: DataFrame) -> DataFrame:
    path = scratch.folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_facts("weekly_platform_summary_distinct",
       lambda f: weekly.platform_summary(weekly.base(f, AS_OF, with_sketches=True)),
       sql.weekly(sql.distinct_campaigns("platforms", "platform_spend", "platform")))
_facts("weekly_regional_summary_distinct",
       lambda f: weekly.regional_summary(weekly.base(f, AS_OF, "30d", with_sketches=True)),
       sql.weekly(sql.distinct_campaigns("countries", "country_spend", "country", 30), 30))
_facts("regional_country_summary_distinct",
       lambda f: regional.country_summary(regional.performance(f, AS_OF, with_sketches=True)),
       sql.regional(sql.distinct_of_segments("avg_ctr avg_cpa_change")), ("avg_ctr", "avg_cpa_change"))

# ---------------------------------------------------------------- roll-up and bucketed tables


def _rolled_up(facts: DataFrame) -> DataFrame:
    path = scratch.folder(facts.sparkSession)
    rollup.refresh(facts, path)
    return rollup.read(facts.sparkSession, path)


def _redelivered(facts: DataFrame) -> DataFrame:
    """A roll-up whose last days came wrong, some of them with rows that are no facts, and
    were delivered again."""
    path, late = scratch.folder(facts.sparkSession), [AS_OF - timedelta(days=n) for n in range(-3, 5)]
    wrong = facts.withColumn("spend", F.when(F.col("date").isin(late), F.col("spend") + 7).otherwise(F.col("spend")))
    more = facts.limit(1).select(*[F.lit(late[0]).alias(c) if c == "date" else F.col(c) for c in facts.columns])
    rollup.refresh(wrong.unionByName(more), path)
    rollup.refresh(facts, path, late)
    return rollup.read(facts.sparkSession, path)


def _bucketed(facts: DataFrame) -> DataFrame:
    table = f"daily_{uuid.uuid4().hex}"
    rollup.save_table(facts, table, scratch.folder(facts.sparkSession), 8)
    return rollup.read_table(facts.sparkSession, table)


def _from(change, names: list[str], suffix: str) -> None:
    """Queries once more, with the same SQL, on facts that are stored in another form."""
    for name in names:
        source, build, averages = _MADE[name]
        _register(f"{name}_{suffix}", source, lambda f, b=build: b(change(f)), _ORACLES[name], averages)


_from(_rolled_up, ["weekly_base", "weekly_base_30d", "regional_performance", "regional_country_summary", "anomaly_features",
                   "campaign_performance_mom"], "rolled_up")
_from(_redelivered, ["weekly_base", "anomaly_current", "campaign_matches"], "redelivered")
_from(_bucketed, ["campaign_performance", "campaign_problems"], "bucketed")


def _of_known_ids(f: DataFrame) -> DataFrame:
    return campaign.performance(f, AS_OF, TERMS, ids=campaign.matched_ids(f, AS_OF, TERMS))


_facts("campaign_performance_known_ids", _of_known_ids, sql.campaign(sql.doubles("performance", _PERF), TERMS))
_facts("campaign_performance_known_ids_bucketed", lambda f: _of_known_ids(_bucketed(f)),
       sql.campaign(sql.doubles("performance", _PERF), TERMS))
_facts("campaign_report_known_ids",
       lambda f: campaign.report(f, AS_OF, TERMS, ids=campaign.matched_ids(f, AS_OF, TERMS)), sql.campaign_report(TERMS))

# ---------------------------------------------------------------- many search terms

MANY_TERMS = [f"{word} {i}" for i in range(1, 201) for word in ("podcast", "AU LAUNCH", "campaign", "50%", "search")]


def _dictionary(f: DataFrame) -> DataFrame:
    return campaign.matched_names(f, AS_OF, MANY_TERMS)


_facts("campaign_names_many_terms", _dictionary,
       sql.campaign("SELECT * FROM named", MANY_TERMS))
_facts("campaign_matches_many_terms", lambda f: campaign.matches(f, AS_OF, MANY_TERMS, names=_dictionary(f)),
       sql.campaign("SELECT * FROM matches", MANY_TERMS))
_facts("campaign_performance_many_terms", lambda f: campaign.performance(f, AS_OF, MANY_TERMS, names=_dictionary(f)),
       sql.campaign(sql.doubles("performance", _PERF), MANY_TERMS))

# ---------------------------------------------------------------- stored reports


def _stored_reports(f: DataFrame) -> DataFrame:
    """Two reports, one of which is stored again, after a run that got lost half-way."""
    path = scratch.folder(f.sparkSession)
    reports.store(weekly.report(f, AS_OF, countries=["Nowhere"]), path, "weekly", AS_OF)
    reports.store(regional.report(f, AS_OF), path, "regional", AS_OF)
    weekly.report(f, AS_OF, "30d").write.parquet(f"{path}/rows/report=regional/as_of={AS_OF}/run=lost")
    reports.store(weekly.report(f, AS_OF), path, "weekly", AS_OF)
    return reports.read(f.sparkSession, path).drop("as_of")


_facts("stored_reports", _stored_reports, f"""
  SELECT 'weekly' AS report, * FROM ({sql.weekly_report()})
  UNION ALL SELECT 'regional' AS report, * FROM ({sql.regional_report()})""")

# ---------------------------------------------------------------- fractional counts, many keys


_of(derived.blended_summary_decimal, sql.decimal_counts, ["weekly_base", "campaign_performance"])
_of(derived.blended_summary_many_keys, sql.many_keys,
    ["campaign_performance", "campaign_creatives", "creative_data", "anomaly_features", "anomaly_features_rolled_up",
     "campaign_performance_bucketed", "campaign_performance_known_ids", "campaign_names_many_terms",
     "campaign_matches_many_terms", "campaign_performance_many_terms"])
_of(derived.impression_share_report_many_keys, sql.many_keys, ["impression_base", "impression_base_approximate", "impression_ranked"])
