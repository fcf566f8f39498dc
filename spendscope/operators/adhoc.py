"""Ad-hoc questions: governed SQL over the fact tables, an audit of query texts and
four ready-made queries."""

from __future__ import annotations

from datetime import date
from typing import Mapping, Sequence

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.functions import governed, guard, kpi, periods, text
from spendscope.settings import SETTINGS, Settings
from spendscope.sources.schemas import FACT_SCHEMAS


class QueryRefused(ValueError):
    """The query text breaks a rule of governed SQL."""


def governed_sql(
    spark: SparkSession,
    query: str,
    tables: Sequence[str] = tuple(FACT_SCHEMAS),
    aliases: Mapping[str, str] | None = None,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Run one read-only SELECT over the fact views; its result is whole.

    ``tables`` names the views (registered by the caller with
    ``createOrReplaceTempView``), ``aliases`` maps further names a query may use for
    them, such as a qualified ``project.dataset.table``. Everything is decided on the
    plan that Spark parses: its nodes and functions must be on the lists of
    ``functions.governed``; every relation must be one of the views or a CTE of the
    query; a query with a join may name only one view, once, and joins need an equality;
    and there must be a LIMIT or an aggregate. ``SAFE_DIVIDE(a, b)`` and
    ``WEEK_START(day)`` are there besides Spark's functions, unless the session has
    functions of that name.
    """
    select = query.strip().rstrip(";").rstrip()
    if len(select) > settings.max_query_length:
        raise QueryRefused(f"longer than {settings.max_query_length} characters")
    try:
        select = governed.Parsed(spark, select).with_views(aliases or {})
        parsed = governed.Parsed(spark, select)
    except ParseException as error:
        raise QueryRefused("not a query that Spark can parse") from error
    _check(spark, parsed, tables)
    for name, statement in _FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(statement)
    result = spark.sql(select)
    if governed.unequal_join(spark, result._jdf.queryExecution().optimizedPlan()):
        raise QueryRefused("a join needs an equality between its sides")
    return result


# Two functions of ad-hoc queries that Spark has under other names.
_FUNCTIONS = {
    "safe_divide": """CREATE TEMPORARY FUNCTION SAFE_DIVIDE(a DOUBLE, b DOUBLE) RETURNS DOUBLE
       RETURN try_divide(a, b)""",
    "week_start": """CREATE TEMPORARY FUNCTION WEEK_START(day DATE) RETURNS DATE
       RETURN date_sub(day, dayofweek(day) - 1)""",
}


def _check(spark: SparkSession, parsed: governed.Parsed, tables: Sequence[str]) -> None:
    if strange := parsed.kinds - governed.NODES:
        raise QueryRefused(f"only SELECT queries are allowed, not {', '.join(sorted(strange))}")
    if strange := parsed.functions - governed.FUNCTIONS:
        raise QueryRefused(f"functions not allowed: {', '.join(sorted(strange))}")
    allowed = {name.lower() for name in tables}
    facts = 0
    for parts in parsed.relations:
        name = ".".join(parts).lower()
        if name in allowed:
            facts += 1
        elif len(parts) > 1 or spark.catalog.tableExists(name):
            # any other name must be a CTE, which it can only be if nothing else has it
            raise QueryRefused(f"relation {name!r} is not allowed")
    if not facts:
        raise QueryRefused(f"the query must read one of {sorted(tables)}")
    if facts > 1 and "Join" in parsed.kinds:
        raise QueryRefused("a query with a join may name a fact table only once")
    if not parsed.kinds & {"GlobalLimit", "Aggregate"} and not parsed.functions & governed.AGGREGATES:
        raise QueryRefused("a LIMIT or an aggregate is needed")


def query_guard_audit(
    queries: DataFrame, text_column: str, allowed_tables: Sequence[str], settings: Settings = SETTINGS
) -> DataFrame:
    """Adds ``verdict`` and ``rule`` to a table of query texts: which ones the text
    rules let through, and the first rule that stops each other one."""
    # trimmed and lower-case text are columns of their own: the rules share them
    query = guard.QueryText(F.col("_cleaned"), F.col("_lowered"))
    return (
        queries.withColumn("_cleaned", text.strip(F.col(text_column)))
        .withColumn("_lowered", F.lower("_cleaned"))
        .withColumn("rule", guard.first_failed_rule(query, allowed_tables, settings))
        .withColumn("verdict", F.when(F.col("rule") == guard.PASSED, "PASS").otherwise("REJECT"))
        .drop("_cleaned", "_lowered")
    )


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def weekly_platform_spend(facts: DataFrame, first: date, last: date, limit: int | None = None) -> DataFrame:
    """Spend per week (from Sunday) and platform."""
    rows = (
        facts.where((F.col("date") >= F.lit(first)) & (F.col("date") <= F.lit(last)))
        .groupBy(periods.week_start(F.col("date")).alias("week"), "platform")
        .agg(F.sum("spend").alias("weekly_spend"))
        .orderBy("week", F.asc_nulls_first("platform"))
    )
    return _first(rows, limit)


def platform_comparison(facts: DataFrame, as_of: date, limit: int | None = None) -> DataFrame:
    """Mean CPA of the rows and conversions per platform, 30 days."""
    rows = (
        facts.where(periods.current(as_of, 30))
        .groupBy("platform")
        .agg(F.avg("cpa").alias("avg_cpa"), F.sum("conversions").alias("total_conversions"))
        .orderBy(F.asc_nulls_first("avg_cpa"), F.asc_nulls_first("platform"))
    )
    return _first(rows, limit)


def visibility(impressions: DataFrame, as_of: date, limit: int | None = None) -> DataFrame:
    """Mean impression share and budget loss per region and campaign type, 14 days."""
    ties = [F.asc_nulls_first("region"), F.asc_nulls_first("campaign_type")]
    rows = (
        impressions.where(periods.current(as_of, 14))
        .groupBy("region", "campaign_type")
        .agg(
            kpi.mean(F.col("search_impression_share_pct")).alias("avg_impression_share"),
            kpi.mean(F.col("budget_lost_impression_share_pct")).alias("avg_budget_lost"),
        )
        .orderBy(F.desc("avg_impression_share"), *ties)
    )
    return _first(rows, limit)


def opportunity_rows(impressions: DataFrame, as_of: date, limit: int = 10) -> DataFrame:
    """The rows that would need the most budget, 7 days."""
    columns = [
        "campaign",
        "region",
        "budget_utilization_pct",
        "budget_lost_impression_share_pct",
        "rank_lost_impression_share_pct",
        "estimated_budget_needed_for_lost_impressions",
    ]
    return (
        impressions.where(periods.current(as_of, 7))
        .where(F.col("budget_lost_impression_share_pct") > 20)
        .select(*columns)
        .orderBy(F.desc(columns[-1]), *[F.asc_nulls_first(c) for c in columns[:-1]])
        .limit(limit)
    )
