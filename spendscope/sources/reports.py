"""A store of packed reports by name and day, in which a rerun replaces its own rows only.

Rows and commits are apart. ``store`` writes the rows of one run to a folder of its own, and then
one small file that says which run holds the report of that day; readers follow the newest
commit of each report and day. A run that is lost half-way has no commit: its rows are never
seen, what was stored before stays whole, and the next run replaces it. No file is renamed or
overwritten, so this holds on object stores too. ``vacuum`` deletes what no commit names.
"""

from __future__ import annotations

import re
import time
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROWS = "section string, summary_data string, report string, as_of date, run string"
_COMMITS = "report string, as_of date, run string, committed_us long"


def store(report: DataFrame, path: str, name: str, as_of: date) -> str:
    """Store a packed report as the one of that name and day; the name of the run."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"a report's name is made of letters, digits and underscores, not {name!r}")
    run = f"run-{uuid.uuid4().hex}"
    report.select("section", "summary_data").write.parquet(f"{path}/rows/report={name}/as_of={as_of}/run={run}")
    commit = report.sparkSession.createDataFrame([(name, as_of, run, time.time_ns() // 1000)], _COMMITS)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return run


def _current(spark: SparkSession, path: str) -> DataFrame:
    """The run that holds each report and day."""
    newest = Window.partitionBy("report", "as_of").orderBy(F.desc("committed_us"), "run")
    commits = spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    return commits.withColumn("_place", F.row_number().over(newest)).where("_place = 1").select("report", "as_of", "run")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``report``, ``as_of``, ``section`` and ``summary_data`` of all stored reports. Filters on the first
    two prune folders."""
    rows = spark.read.schema(_ROWS).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(_current(spark, path), ["report", "as_of", "run"], "left_semi").select(
        "report", "as_of", "section", "summary_data")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders of runs that no reader follows, and count them. No other run may be
    storing meanwhile."""
    kept = {(r["report"], str(r["as_of"]), r["run"]) for r in _current(spark, path).collect()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for folder in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "report=*/as_of=*/run=*")) or []:
        place = folder.getPath()
        run, day, name = (p.getName().split("=", 1)[1] for p in (place, place.getParent(), place.getParent().getParent()))
        if (name, day, run) not in kept:
            files.delete(place, True)
            gone += 1
    return gone
