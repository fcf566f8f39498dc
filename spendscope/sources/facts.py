"""Reading and writing the fact tables, and writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendscope.sources.schemas import FACT_SCHEMAS, checked, require_columns


# columns most filters name: sorted by them, whole pages of a file can be skipped
_CLUSTERING = {
    "blended_summary": ["platform", "country"],
    "impression_share_report": ["region"],
}


def read_facts(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Read a fact table stored as parquet. Types are those of the files; a type that does
    not fit the table raises ``ValueError``. Only the columns an operator uses are read."""
    return checked(spark.read.parquet(path), FACT_SCHEMAS[table])


def write_facts(df: DataFrame, table: str, path: str, mode: str = "error") -> None:
    """Store a fact table partitioned by day, the layout every date window prunes.

    The rebalance hint groups rows by day before the write, and adaptive execution
    splits a day that holds far more rows than the others over several tasks. Within a
    file the rows are sorted by the columns that filters name. Columns and types are
    written as they are; one that does not fit the table raises ``ValueError``.
    """
    clustering = [c for c in _CLUSTERING[table] if c in df.columns]
    (
        checked(require_columns(df, ["date"]), FACT_SCHEMAS[table])
        .hint("rebalance", "date")
        .sortWithinPartitions("date", *clustering)
        .write.mode(mode)
        .partitionBy("date")
        .parquet(path)
    )


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Store a packed report or a section as files."""
    report.write.mode(mode).format(fmt).save(path)
