"""Schemas of the two fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 2)
_PERCENT = T.DecimalType(9, 2)


def _struct(columns: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns])


# Column names and order of the two tables. The numeric types are those of
# columns that are missing; a table's own numeric types are kept.
BLENDED_SUMMARY = _struct(
    [
        ("account_name", T.StringType()),
        ("datasource", T.StringType()),
        ("source", T.StringType()),
        ("date", T.DateType()),
        ("campaign", T.StringType()),
        ("campaign_id", T.StringType()),
        ("adset_name", T.StringType()),
        ("adset_id", T.StringType()),
        ("ad_name", T.StringType()),
        ("ad_id", T.StringType()),
        ("ad_group_name", T.StringType()),
        ("ad_group_id", T.StringType()),
        ("impressions", T.LongType()),
        ("clicks", T.LongType()),
        ("spend", _MONEY),
        ("conversions", T.LongType()),
        ("preview_url", T.StringType()),
        ("country", T.StringType()),
        ("campaign_objective", T.StringType()),
        ("funnel_stage", T.StringType()),
        ("targeting_type", T.StringType()),
        ("product_focus", T.StringType()),
        ("platform", T.StringType()),
        ("ctr_percent", T.DoubleType()),
        ("cpc", T.DoubleType()),
        ("conversion_rate_percent", T.DoubleType()),
        ("cpa", T.DoubleType()),
    ]
)

IMPRESSION_SHARE_REPORT = _struct(
    [
        ("date", T.DateType()),
        ("account_name", T.StringType()),
        ("campaign", T.StringType()),
        ("campaign_type", T.StringType()),
        ("region", T.StringType()),
        ("campaign_category", T.StringType()),
        ("funnel_stage", T.StringType()),
        ("clicks", T.LongType()),
        ("spend", _MONEY),
        ("conversions", T.LongType()),
        ("budget_amount", _MONEY),
        ("search_impression_share_pct", _PERCENT),
        ("search_top_impression_share_pct", _PERCENT),
        ("search_absolute_top_impression_share_pct", _PERCENT),
        ("budget_lost_impression_share_pct", _PERCENT),
        ("rank_lost_impression_share_pct", _PERCENT),
        ("budget_lost_top_impression_share_pct", _PERCENT),
        ("rank_lost_top_impression_share_pct", _PERCENT),
        ("budget_lost_absolute_top_impression_share_pct", _PERCENT),
        ("rank_lost_absolute_top_impression_share_pct", _PERCENT),
        ("market_size_impressions", T.LongType()),
        ("search_click_share_pct", _PERCENT),
        ("content_impression_share_pct", _PERCENT),
        ("content_market_size_impressions", T.LongType()),
        ("avg_cpc", _PERCENT),
        ("conversion_rate_pct", _PERCENT),
        ("cost_per_conversion", _MONEY),
        ("budget_utilization_pct", _PERCENT),
        ("total_lost_impression_share_pct", _PERCENT),
        ("actual_impressions", T.LongType()),
        ("budget_lost_impressions", T.LongType()),
        ("rank_lost_impressions", T.LongType()),
        ("market_position", T.StringType()),
        ("performance_diagnosis", T.StringType()),
        ("is_brand_campaign", T.BooleanType()),
        ("prev_week_impression_share", _PERCENT),
        ("wow_impression_share_change", _PERCENT),
        ("estimated_budget_needed_for_lost_impressions", _MONEY),
        ("estimated_clicks_from_rank_improvement", T.LongType()),
    ]
)

FACT_SCHEMAS = {
    "blended_summary": BLENDED_SUMMARY,
    "impression_share_report": IMPRESSION_SHARE_REPORT,
}


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail on the driver, with all missing names, before any job starts."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _accepted(declared: T.DataType, found: T.DataType) -> bool:
    """Whether a column may have the type it has: measures any number, kept as it is,
    every other column the declared type."""
    if isinstance(declared, T.NumericType):
        return isinstance(found, T.NumericType)
    return type(declared) is type(found)


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` as it is, if its columns of the table have fitting types. Types come from the
    data: a fractional count stays fractional, and columns the table does not name stay."""
    types = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}"
        for f in schema if f.name in types and not _accepted(f.dataType, types[f.name])
    ]
    if wrong:
        raise ValueError("wrong types: " + "; ".join(wrong))
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of the table in its order: what is there unchanged, typed NULL for what
    is not, further columns last."""
    names = set(schema.names)
    return checked(df, schema).select(
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        ],
        *[c for c in df.columns if c not in names],
    )
