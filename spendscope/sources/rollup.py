"""A stored daily roll-up of ad performance, from which every date window is answered.

One row for each day, platform, country, objective, campaign id and name, and for rows with
and without spend, holds the sums of the measures. Sums add up, and whether spend is above
zero is the only condition that reports put on single rows, so ``weekly``, ``regional``,
``anomaly`` and ``campaign`` (all but its creatives) read the roll-up in place of the facts
and give the same rows. A window of 60 days then reads some rows for each campaign in place
of all its ads; a campaign with a third of the facts has no more rows than any other.

Days are partitions. ``refresh`` replaces the days it is given and touches no others, so a
day that is delivered again, late or corrected, costs one day. A replaced day without any
facts keeps one marker row, which readers leave out; otherwise its old rows would stay.

``save_table`` stores the same rows in buckets by campaign id: totals of a campaign, and joins
by it, then need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.sources.schemas import require_columns

KEYS = ["platform", "country", "campaign_objective", "campaign_id", "campaign"]
MEASURES = ["spend", "conversions", "clicks", "impressions"]
BUCKET_KEY = "campaign_id"


def daily(facts: DataFrame) -> DataFrame:
    """The rows of the roll-up; ``fact_rows`` is the number of facts in each. Facts without a day
    are in no window, and left out."""
    spending = F.coalesce(F.col("spend") > 0, F.lit(False))
    return (
        require_columns(facts, ["date", *KEYS, *MEASURES])
        .where(F.col("date").isNotNull())
        .groupBy(*KEYS, spending.alias("spending"), "date")
        .agg(*[F.sum(m).alias(m) for m in MEASURES], F.count("*").alias("fact_rows"))
        .select(*KEYS, "spending", *MEASURES, "fact_rows", "date")
    )


def _of_days(facts: DataFrame, days: Sequence[date] | None) -> DataFrame:
    """The rows of these days, and a marker for each of them that has none; of all days of the
    facts without ``days``."""
    if days is None:
        return daily(facts)
    wanted = sorted(set(days))
    rows = daily(facts.where(F.col("date").isin(wanted)))
    marks = facts.sparkSession.createDataFrame([(d,) for d in wanted], "date date")
    return marks.join(rows, "date", "left").select(
        *[c for c in rows.columns if c not in ("fact_rows", "date")], F.coalesce("fact_rows", F.lit(0)).alias("fact_rows"), "date")


def _rows(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("fact_rows") > 0)


def refresh(facts: DataFrame, path: str, days: Sequence[date] | None = None) -> None:
    """Store the facts of ``days`` (of all their days, unless given) in place of what the roll-up
    at ``path`` has for these days."""
    rows = _of_days(facts, days)
    (
        rows.hint("rebalance", "date")
        .sortWithinPartitions("date", BUCKET_KEY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The roll-up, with the columns of the facts that reports sum."""
    return _rows(spark.read.parquet(path))


def save_table(facts: DataFrame, table: str, path: str, buckets: int) -> None:
    """Store the roll-up as a catalog table at ``path``: partitions by day, in each of them
    ``buckets`` files by campaign id. A campaign has one row a day and appearance, so one that
    holds much of the facts makes no large bucket."""
    (
        daily(facts).repartition(buckets, BUCKET_KEY)
        .write.mode("error")
        .option("path", path)
        .partitionBy("date")
        .bucketBy(buckets, BUCKET_KEY)
        .sortBy(BUCKET_KEY)
        .saveAsTable(table)
    )


def refresh_table(facts: DataFrame, table: str, days: Sequence[date] | None = None) -> None:
    """Like ``refresh`` for a table of ``save_table``."""
    conf, name = facts.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    rows = _of_days(facts, days).select(*facts.sparkSession.table(table).columns)
    # an insert takes the mode from the session only
    before = conf.get(name, None)
    conf.set(name, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return _rows(spark.table(table))
