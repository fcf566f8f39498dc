"""Headline queries on facts stored once as parquet, partitioned by day.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores, BENCH_COPIES
repeats every fact row (to see how time grows with data), BENCH_RUNS sets how often a
query runs after its warm-up; the best run counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.operators import adhoc, anomaly, campaign, creative, impression, regional, weekly
from spendscope.sources import derived, facts

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
AS_OF = derived.AS_OF


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("spendscope-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored(spark: SparkSession, folder: str, table: str, derive) -> DataFrame:
    rows = derive(spark, SF_DIR)
    if COPIES > 1:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    schema = table.removesuffix("_many")
    facts.write_facts(rows, schema, f"{folder}/{table}")
    return facts.read_facts(spark, schema, f"{folder}/{table}")


def main() -> None:
    spark = session()
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").unionByName(
        spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("text"))
    with tempfile.TemporaryDirectory(prefix="spendscope-bench-") as folder:
        start = time.perf_counter()
        f = stored(spark, folder, "blended_summary", derived.blended_summary)
        i = stored(spark, folder, "impression_share_report", derived.impression_share_report)
        load = time.perf_counter() - start

        def features():
            return anomaly.features(f, AS_OF)

        many = stored(spark, folder, "blended_summary_many", derived.blended_summary_many_keys)
        many_shares = stored(spark, folder, "impression_share_report_many", derived.impression_share_report_many_keys)

        queries = {
            "campaign_performance_many_keys": lambda: campaign.performance(many, AS_OF, ["grow_c"]),
            "campaign_creatives_many_keys": lambda: campaign.creatives(
                many, AS_OF, campaign.match_counts(campaign.matches(many, AS_OF, ["grow_c"]))),
            "creative_data_many_keys": lambda: creative.data(many, AS_OF),
            "anomaly_features_many_keys": lambda: anomaly.features(many, AS_OF),
            "impression_base_many_keys": lambda: impression.base(many_shares, AS_OF),
            "impression_ranked_many_keys": lambda: impression.ranked(
                impression.classified(impression.base(many_shares, AS_OF))),
            "weekly_report": lambda: weekly.report(f, AS_OF),
            "weekly_report_30d": lambda: weekly.report(f, AS_OF, "30d"),
            "weekly_base": lambda: weekly.base(f, AS_OF),
            "campaign_report": lambda: campaign.report(f, AS_OF, ["grow_c"], include_creatives=True),
            "campaign_performance": lambda: campaign.performance(f, AS_OF, ["grow_c"]),
            "creative_report": lambda: creative.report(f, AS_OF),
            "creative_data": lambda: creative.data(f, AS_OF),
            "regional_report": lambda: regional.report(f, AS_OF),
            "regional_performance": lambda: regional.performance(f, AS_OF),
            "anomaly_report": lambda: anomaly.report(f, AS_OF),
            "anomaly_features": features,
            "impression_report": lambda: impression.report(i, AS_OF),
            "impression_base": lambda: impression.base(i, AS_OF),
            "adhoc_weekly_platform_spend": lambda: adhoc.weekly_platform_spend(
                f, date(2024, 1, 1), date(2024, 3, 31)),
            "query_guard_audit": lambda: adhoc.query_guard_audit(
                texts, "text", ["warehouse.ads.blended_summary"]).groupBy("rule").count(),
        }
        seconds = {}
        for name, query in queries.items():
            times = []
            for _ in range(RUNS + 1):
                spark.catalog.clearCache()  # rows that a run has shared are not kept for the next
                start = time.perf_counter()
                query().collect()
                times.append(time.perf_counter() - start)
            seconds[name] = round(min(times[1:]), 4)
        rows = f.count()
        spark.stop()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "fact_rows": rows,
        "load_seconds": round(load, 3),
        "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
