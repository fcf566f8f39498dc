from __future__ import annotations

import sys
from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spendscope.sources.schemas import BLENDED_SUMMARY, IMPRESSION_SHARE_REPORT  # noqa: E402

AS_OF = date(2024, 1, 30)


def day(offset: int) -> date:
    """``offset`` days before the reference day."""
    return AS_OF - timedelta(days=offset)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("spendscope-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _frame(spark, schema, defaults, rows):
    def value(name, row):
        v = {**defaults, **row}.get(name)
        dtype = schema[name].dataType.typeName()
        return Decimal(str(v)) if dtype == "decimal" and v is not None else v

    data = [tuple(value(name, row) for name in schema.names) for row in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def facts(spark):
    """Performance facts from partial rows."""
    defaults = dict(
        date=day(1), platform="Meta", country="US", campaign_id="c1", campaign="Grow one",
        campaign_objective="Traffic", ad_id="a1", ad_name="A // b", spend=100, conversions=10,
        clicks=50, impressions=1000,
    )
    return lambda rows: _frame(spark, BLENDED_SUMMARY, defaults, rows)


@pytest.fixture(scope="session")
def shares(spark):
    """Impression share facts from partial rows."""
    defaults = dict(
        date=day(1), region="US", campaign="Grow one", campaign_type="Search", campaign_category="Core",
        funnel_stage="TOF", is_brand_campaign=False, spend=1000, conversions=10, clicks=50,
        actual_impressions=2000, market_size_impressions=10000, search_impression_share_pct=50,
        search_top_impression_share_pct=40, search_absolute_top_impression_share_pct=30,
        budget_lost_impression_share_pct=20, rank_lost_impression_share_pct=10,
        budget_utilization_pct=70, estimated_budget_needed_for_lost_impressions=100,
        estimated_clicks_from_rank_improvement=5, wow_impression_share_change=1,
        market_position="dominant", performance_diagnosis="fine",
    )
    return lambda rows: _frame(spark, IMPRESSION_SHARE_REPORT, defaults, rows)


def rows_of(df, *columns):
    """Rows as sorted tuples of the named columns; decimals as float."""
    def plain(v):
        return float(v) if isinstance(v, Decimal) else v

    found = [tuple(plain(r[c]) for c in columns or df.columns) for r in df.collect()]
    return sorted(found, key=lambda t: tuple((x is not None, str(x)) for x in t))
