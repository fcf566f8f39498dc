"""The two fact tables, derived from the order tables used for testing.

One fact row per line item; the country comes from the customer's region. The
joins carry only keys and the region name, and are left to Catalyst: nation and
region are a few rows, and whether orders or customer can be broadcast is decided
from their size.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.sources.schemas import BLENDED_SUMMARY, IMPRESSION_SHARE_REPORT, conform

AS_OF = date(2024, 1, 30)

_COUNTRY = """
    CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'ASIA' THEN 'AU' WHEN 'EUROPE' THEN 'UK'
                WHEN 'AFRICA' THEN 'CA' ELSE 'NZ' END"""
_CAMPAIGN = """
    concat(CASE k % 6 WHEN 0 THEN 'Podcast' WHEN 1 THEN 'AU Launch' WHEN 2 THEN 'Grow_Campaign'
                      WHEN 3 THEN 'Earn 50%' WHEN 4 THEN 'Brand Search' ELSE 'Retarget' END,
           ' ', CAST(k AS STRING))"""
_DAY = "date_sub(DATE '2024-01-30', off)"
_CLICKS = "qty * (1 + disc_pp) div 2"
_SPEND = "CAST(spend_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


_FEW = "l_partkey % 24"
# a campaign for each part, and one of them with half of all rows; spend is a hundredfold, so
# that campaigns of few rows are above the limits of reports
_MANY = "CASE WHEN l_orderkey % 2 = 0 THEN 8 ELSE l_partkey END"


def _line_items(spark: SparkSession, sf_dir: str, campaign: str = _FEW, cents: int = 10_000) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    regions = table("nation").join(
        table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "r_name")
    customers = table("customer").join(
        regions, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "r_name")
    orders = table("orders").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "r_name")
    return (
        table("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(
            "l_orderkey",
            "l_suppkey",
            "l_linenumber",
            "l_returnflag",
            "r_name",
            f"{campaign} AS k",
            "CAST(datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01') % 60 AS INT) AS off",
            "CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents",
            "CAST(round(l_discount * 100) AS BIGINT) AS disc_pp",
            "CAST(l_quantity AS BIGINT) AS qty",
        )
        .selectExpr(
            "*",
            f"""price_cents * (CASE WHEN off <= 7 AND k % 5 = 0 THEN 7 + k % 12
                                   ELSE 2 + k % 12 END) div {cents} AS spend_cents""",
        )
    )


def blended_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _performance(_line_items(spark, sf_dir))


def blended_summary_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts with fractional conversions."""
    return _performance(_line_items(spark, sf_dir), conversions="CAST(qty / 20 AS DECIMAL(18,2))")


def blended_summary_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts with keys that grow with the data: a campaign for each part, an ad
    for each order, and half of all rows in one campaign."""
    return _performance(_line_items(spark, sf_dir, _MANY, 100), ad="l_orderkey")


def _performance(lines: DataFrame, conversions: str = "qty div 20", ad: str = "l_suppkey % 5") -> DataFrame:
    facts = lines.selectExpr(
        f"{_DAY} AS date",
        """CASE k % 4 WHEN 0 THEN 'Meta' WHEN 1 THEN 'Google' WHEN 2 THEN 'Bing'
                      ELSE 'tiktok' END AS platform""",
        f"{_COUNTRY} AS country",
        "concat('cmp_', CAST(k AS STRING)) AS campaign_id",
        f"{_CAMPAIGN} AS campaign",
        """CASE WHEN k = 23 THEN NULL WHEN k % 3 = 0 THEN 'Conversions'
                WHEN k % 3 = 1 THEN 'Awareness' ELSE 'Traffic' END AS campaign_objective""",
        f"concat('ad_', CAST(k AS STRING), '_', CAST({ad} AS STRING)) AS ad_id",
        """CASE l_suppkey % 5
             WHEN 0 THEN concat('Standalone creative ', CAST(k AS STRING))
             WHEN 1 THEN NULL
             WHEN 2 THEN concat('Concept ', CAST(k div 4 AS STRING), ' // v1')
             WHEN 3 THEN concat('Concept ', CAST(k div 4 AS STRING), ' // v2 // Video')
             ELSE concat('Concept ', CAST(k div 4 AS STRING), ' // v3 // Static // Creator ',
                         CAST(k % 3 AS STRING)) END AS ad_name""",
        "qty * 60 AS impressions",
        f"{_CLICKS} AS clicks",
        f"{_SPEND} AS spend",
        f"{conversions} AS conversions",
        f"try_divide(CAST({_SPEND} AS DOUBLE), CAST({conversions} AS DOUBLE)) AS cpa",
    )
    return conform(facts, BLENDED_SUMMARY)


def impression_share_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(_line_items(spark, sf_dir))


def impression_share_report_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts with a campaign for each part, half of all rows in one of them, and
    free-text diagnoses."""
    diagnosis = """CASE WHEN l_returnflag = 'A' THEN NULL
                        ELSE concat('order ', CAST(l_orderkey % 5000 AS STRING)) END"""
    return _shares(_line_items(spark, sf_dir, _MANY, 100), diagnosis)


_DIAGNOSIS = """CASE l_returnflag WHEN 'A' THEN 'budget limited' WHEN 'R' THEN 'rank limited'
                             ELSE NULL END"""


def _shares(lines: DataFrame, diagnosis: str = _DIAGNOSIS) -> DataFrame:
    facts = lines.selectExpr(
        f"{_DAY} AS date",
        f"{_COUNTRY} AS region",
        f"{_CAMPAIGN} AS campaign",
        """CASE k % 3 WHEN 0 THEN 'Search' WHEN 1 THEN 'Shopping'
                      ELSE 'Performance Max' END AS campaign_type""",
        "CASE WHEN k % 2 = 0 THEN 'Core' ELSE 'Expansion' END AS campaign_category",
        "CASE WHEN k % 4 < 2 THEN 'TOF' ELSE 'BOF' END AS funnel_stage",
        "CASE WHEN k % 7 = 0 THEN NULL ELSE k % 6 = 4 END AS is_brand_campaign",
        f"{_CLICKS} AS clicks",
        f"{_SPEND} AS spend",
        "qty div 20 AS conversions",
        "qty * 60 AS actual_impressions",
        "qty * 60 * (2 + disc_pp % 4) AS market_size_impressions",
        "CAST(20 + disc_pp * 3 AS DECIMAL(9,2)) AS search_impression_share_pct",
        "CAST(10 + disc_pp * 2 AS DECIMAL(9,2)) AS search_top_impression_share_pct",
        "CAST(5 + disc_pp AS DECIMAL(9,2)) AS search_absolute_top_impression_share_pct",
        """CASE WHEN l_linenumber % 7 = 0 THEN NULL
                ELSE CAST((k * 2) % 45 AS DECIMAL(9,2)) END AS budget_lost_impression_share_pct""",
        "CAST((k * 5) % 45 AS DECIMAL(9,2)) AS rank_lost_impression_share_pct",
        """CASE WHEN k = 11 THEN NULL
                ELSE CAST(50 + (k * 7) % 50 AS DECIMAL(9,2)) END AS budget_utilization_pct""",
        """CAST((spend_cents * ((k * 2) % 45) div 100) * CAST(0.01 AS DECIMAL(3,2))
                AS DECIMAL(18,2)) AS estimated_budget_needed_for_lost_impressions""",
        f"{_CLICKS} * ((k * 5) % 45) div 100 AS estimated_clicks_from_rank_improvement",
        "CAST(disc_pp - 5 AS DECIMAL(9,2)) AS wow_impression_share_change",
        """CASE (qty + k) % 4 WHEN 0 THEN 'dominant' WHEN 1 THEN 'competitive'
                             WHEN 2 THEN 'lagging' ELSE NULL END AS market_position""",
        f"{diagnosis} AS performance_diagnosis",
    )
    return conform(facts, IMPRESSION_SHARE_REPORT)
