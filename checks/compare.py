"""Run registered queries against their SQL and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from checks.queries import oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return float(v) if isinstance(v, Decimal) else v

    table = [tuple(value(r[i]) for i in order) for r in rows]
    return sorted(table, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when columns, types and values are the same."""
    return frame_difference(queries()[name](spark, sf_dir), con, oracle_sql()[name])


def frame_difference(frame, con, oracle: str) -> str | None:
    ours = frame.collect()
    cursor = con.execute(oracle)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    left, right = _sorted(ours, frame.columns), _sorted(theirs, columns)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            pairs = [f"{c}: {x!r} != {y!r}" for c, x, y in zip(sorted(columns), a, b)
                     if x != y or type(x) is not type(y)]
            return "; ".join(pairs)
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(oracle_sql())
    spark, con = session(), duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the other queries
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}"[:1500],
              flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
