"""Roll-ups, bucketed tables, sketches and the store of reports: rows, plans, sizes."""

import gc
import random
import re
import uuid
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import AS_OF, day, rows_of
from pyspark.sql import functions as F

from spendscope.functions import sketches
from spendscope.operators import anomaly, campaign, impression, regional, weekly
from spendscope.sources import reports, rollup
from test_edge_oracle import frame, performance_row
from spendscope.sources.schemas import BLENDED_SUMMARY


@pytest.fixture(scope="module")
def edge_facts(spark):
    return frame(spark, BLENDED_SUMMARY, performance_row, 5, 3000).cache()


BASES = {
    "weekly 7d": lambda f: weekly.base(f, AS_OF, "7d"),
    "weekly 60d": lambda f: weekly.base(f, AS_OF, "30d"),
    "regional": lambda f: regional.performance(f, AS_OF),
    "anomaly": lambda f: anomaly.features(f, AS_OF, min_impact_threshold=100),
    "campaign": lambda f: campaign.performance(f, AS_OF, ["grow", "earn", "a"], "month_over_month"),
}


def stamps(path):
    """Files of each day with their times."""
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).glob("date=*/*.parquet")}


def test_bases_from_the_roll_up_and_a_late_day(spark, edge_facts, tmp_path):
    path = str(tmp_path / "daily")
    rollup.refresh(edge_facts, path)
    stored = rollup.read(spark, path)
    for name, base in BASES.items():
        assert rows_of(base(stored)) == rows_of(base(edge_facts)), name
    assert stored.count() < edge_facts.count()

    late, emptied = day(2), day(9)
    changed = edge_facts.where(F.col("date") != emptied).withColumn(
        "spend", F.when(F.col("date") == late, F.col("spend") * 3).otherwise(F.col("spend")).cast("decimal(18,2)"))
    before = stamps(path)
    rollup.refresh(changed, path, [late, emptied])
    after = stamps(path)
    moved = {k.split("/")[0] for k in before.keys() ^ after.keys()} | {k.split("/")[0] for k in before if after.get(k, before[k]) != before[k]}
    assert moved == {f"date={late}", f"date={emptied}"}
    again = rollup.read(spark, path)
    for name, base in BASES.items():
        assert rows_of(base(again)) == rows_of(base(changed)), name
    assert again.where(F.col("date") == emptied).count() == 0


def test_roll_up_of_a_hot_campaign_and_of_nothing(spark, facts, tmp_path):
    hot = facts([dict(ad_id=f"a{i}", date=day(i % 3)) for i in range(300)] + [dict(date=None), dict(spend=None)])
    found = rollup.daily(hot)
    assert found.count() == 4 and found.agg(F.sum("fact_rows")).first()[0] == 301
    rollup.refresh(hot.where("false"), str(tmp_path / "none"), [day(0)])
    assert rollup.read(spark, str(tmp_path / "none")).count() == 0


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


@pytest.fixture(scope="module")
def bucketed(spark, edge_facts, tmp_path_factory):
    table = f"daily_{uuid.uuid4().hex}"
    rollup.save_table(edge_facts, table, str(tmp_path_factory.mktemp("b") / "t"), 4)
    yield table
    spark.sql(f"DROP TABLE {table}")


def test_campaign_totals_of_a_bucketed_table_need_no_shuffle(spark, edge_facts, bucketed):
    of = lambda f, **more: campaign.performance(f, AS_OF, ["grow", "earn"], "month_over_month", **more)
    found = of(rollup.read_table(spark, bucketed))
    text = plan(found)
    assert "Exchange" not in text and "Bucketed: true" in text
    assert "Exchange hashpartitioning(campaign_id" in plan(of(edge_facts))
    assert rows_of(found) == rows_of(of(edge_facts))
    ids = campaign.matched_ids(edge_facts, AS_OF, ["grow"], "month_over_month")
    few = campaign.performance(rollup.read_table(spark, bucketed), AS_OF, ["grow"], "month_over_month", ids=ids[:1])
    assert re.search(r"SelectedBucketsCount: 1 out of 4", plan(few))


def test_late_day_of_a_bucketed_table(spark, edge_facts, tmp_path):
    table = f"daily_{uuid.uuid4().hex}"
    rollup.save_table(edge_facts, table, str(tmp_path / "t"), 4)
    changed = edge_facts.where(F.col("date") != day(4)).withColumn(
        "clicks", F.when(F.col("date") == day(1), 7).otherwise(F.col("clicks")))
    rollup.refresh_table(changed, table, [day(1), day(4)])
    for name, base in BASES.items():
        assert rows_of(base(rollup.read_table(spark, table))) == rows_of(base(changed)), name
    spark.sql(f"DROP TABLE {table}")


def shuffled(df):
    """Rows written to shuffles while the frame runs."""
    df.collect()
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                rows += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_known_ids_are_filtered_at_the_scan(spark, facts, tmp_path):
    made = facts([dict(campaign_id=f"c{i}", campaign=f"Name {i}", date=day(d)) for i in range(400) for d in (1, 9)])
    made.repartitionByRange(4, "campaign_id").write.parquet(f"{tmp_path}/f")
    stored = spark.read.parquet(f"{tmp_path}/f")
    terms = ["name 39"]
    ids = campaign.matched_ids(stored, AS_OF, terms)
    assert ids == sorted(["c39", *[f"c39{i}" for i in range(10)]])
    plain, pruned = campaign.performance(stored, AS_OF, terms), campaign.performance(stored, AS_OF, terms, ids=ids)
    assert rows_of(pruned) == rows_of(plain) and len(rows_of(plain)) == 11
    assert shuffled(pruned) * 20 <= shuffled(plain)
    assert "campaign_id" in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan(pruned)).group(1)
    assert campaign.matched_ids(stored, AS_OF, terms, at_most=10) is None
    assert campaign.performance(stored, AS_OF, terms, ids=[]).count() == 0


# ---------------------------------------------------------------- sketches


def test_leading_label_against_exact_counts(spark):
    rng = random.Random(1)
    rows = []
    for key in range(30):
        leader = rng.choice([None, "lead", "a"])
        others = [f"label {rng.randrange(3000)}" for _ in range(4000)]
        rows += [(key, x) for x in [leader] * rng.randrange(40, 900) + others[:rng.choice([3, 400, 4000])]]
    df = spark.createDataFrame(rows, "key int, label string").repartition(6)
    counts = {}
    for key, label in rows:
        counts.setdefault(key, {}).setdefault(label, 0)
        counts[key][label] += 1
    parts = df.groupBy("key", F.spark_partition_id().alias("p")).agg(sketches.label_counts(F.col("label")).alias("s"))
    found = parts.groupBy("key").agg(sketches.merged_label_counts(F.col("s")).alias("s")).select(
        "key", sketches.leading_label(F.col("s")).alias("x"), F.length("s.sketch").alias("size")).collect()
    sure = 0
    for r in found:
        ranked = sorted(counts[r["key"]].items(), key=lambda c: (-c[1], c[0] is not None, c[0]))
        if len(ranked) == 1 or ranked[0][1] > 2 * ranked[1][1] or len(ranked) <= 700:
            sure += 1
            assert r["x"]["label"] == ranked[0][0], r["key"]
    assert sure >= 25


def test_state_size_does_not_grow_with_labels(spark):
    def size(n):
        labels = spark.range(n * 3).select(F.format_string("%08d", F.col("id") % n).alias("v"))
        return labels.agg(sketches.label_counts(F.col("v"), 256).alias("s")).select(F.length("s.sketch")).first()[0]

    few, many, more = size(100), size(20_000), size(200_000)
    assert few < many and more <= 1.3 * many


def test_leading_label_of_ties_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "a"), (3, None)], "k int, v string")
    lead = df.groupBy("k").agg(sketches.label_counts(F.col("v")).alias("s")).select("k", sketches.leading_label(F.col("s")).alias("x"))
    assert {(r["k"], r["x"]["label"], r["x"]["count"]) for r in lead.collect()} == {(1, "a", 1), (2, None, 1), (3, None, 1)}
    none = df.where("false").agg(sketches.label_counts(F.col("v")).alias("s")).select(sketches.leading_label(F.col("s")).alias("x"))
    assert none.first()["x"] is None


def test_approximate_base_shuffles_one_row_a_task_and_campaign(shares):
    rows = shares([dict(performance_diagnosis=f"text {i}") for i in range(200)]).repartition(3)
    exact, sketched = impression.base(rows, AS_OF), impression.base(rows, AS_OF, approximate=True)
    assert exact.columns == sketched.columns and rows_of(exact) == rows_of(sketched)
    assert shuffled(sketched) <= 3 + 200 and shuffled(sketched) < shuffled(exact)


def test_distinct_campaigns_of_many(spark, facts):
    """Campaigns in several segments count once; the error stays small for many."""
    many = facts([dict(spend=1000, conversions=100)]).drop("campaign_id").crossJoin(
        spark.range(40_000).select(F.concat(F.lit("c"), F.col("id") % 20_000).alias("campaign_id"),
                                   F.when(F.col("id") < 20_000, "US").otherwise("AU").alias("c2"))
    ).withColumn("country", F.col("c2")).drop("c2").select(BLENDED_SUMMARY.names)
    (row,) = weekly.platform_summary(weekly.base(many, AS_OF, with_sketches=True)).collect()
    assert row["total_campaigns"] == 40_000 and abs(row["distinct_campaigns"] - 20_000) <= 0.03 * 20_000
    few = many.where(F.col("campaign_id").rlike("^c[0-9]{1,2}$"))
    (row,) = weekly.platform_summary(weekly.base(few, AS_OF, with_sketches=True)).collect()
    assert (row["total_campaigns"], row["distinct_campaigns"]) == (200, 100)
    country = regional.country_summary(regional.performance(few, AS_OF, with_sketches=True)).collect()
    assert {r["country"]: r["distinct_campaigns"] for r in country} == {"US": 100, "AU": 100}
    assert "campaign_sketch" not in weekly.base(few, AS_OF).columns


# ---------------------------------------------------------------- reports


def test_a_lost_run_changes_nothing(spark, facts, tmp_path):
    path = str(tmp_path)
    first = weekly.report(facts([{}]), AS_OF)
    reports.store(first, path, "weekly", AS_OF)
    reports.store(first, path, "weekly", AS_OF - timedelta(days=1))
    # a run that dies between two of its files
    broken = first.repartition(4, "section").withColumn("summary_data", F.when(
        F.col("section") == "TOP_ISSUES", F.raise_error(F.lit("lost"))).otherwise(F.col("summary_data")))
    with pytest.raises(Exception, match="lost"):
        reports.store(broken, path, "weekly", AS_OF)
    of_day = lambda d: rows_of(reports.read(spark, path).where(F.col("as_of") == d), "section", "summary_data")
    assert of_day(AS_OF) == rows_of(first)
    # one that dies after its rows and before its commit
    first.limit(1).write.parquet(f"{path}/rows/report=weekly/as_of={AS_OF}/run=run-lost")
    assert of_day(AS_OF) == rows_of(first)
    second = weekly.report(facts([dict(spend=900)]), AS_OF)
    reports.store(second, path, "weekly", AS_OF)
    assert of_day(AS_OF) == rows_of(second) != rows_of(first) and of_day(AS_OF - timedelta(days=1)) == rows_of(first)
    assert reports.vacuum(spark, path) >= 2 and of_day(AS_OF) == rows_of(second)
    with pytest.raises(ValueError):
        reports.store(second, path, "a/b", AS_OF)


REPORTS = {
    "weekly": lambda f, i: weekly.report(f, AS_OF),
    "campaign": lambda f, i: campaign.report(f, AS_OF, ["grow"]),
    "regional": lambda f, i: regional.report(f, AS_OF),
    "anomaly": lambda f, i: anomaly.report(f, AS_OF),
    "impression": lambda f, i: impression.report(i, AS_OF),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_leave_nothing_persisted(spark, facts, shares, name):
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keys())
    report = REPORTS[name](facts([{}]), shares([{}]))
    report.collect()
    del report
    gc.collect()
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keys()) <= before
