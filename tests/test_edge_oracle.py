"""Every report query against its SQL on random rows full of edges: NULL keys and
measures, zero denominators, ids under several names and objectives, later dates."""

import random
from decimal import Decimal

import duckdb
import pytest
from conftest import day

from checks import oracles
from checks.compare import frame_difference
from checks.queries import builds, oracle_sql
from spendscope.sources import derived
from spendscope.sources.schemas import BLENDED_SUMMARY, IMPRESSION_SHARE_REPORT


def money(rng, top):
    return rng.choice([Decimal(0), None, Decimal(rng.randint(-500, 100)) / 100,
                       *[Decimal(rng.randint(0, top * 100)) / 100 for _ in range(6)]])


def count(rng, top):
    return rng.choice([0, None, 1, *[rng.randint(0, top) for _ in range(5)]])


def performance_row(rng):
    k = rng.randint(0, 9)
    names = ["Grow_Campaign 1", "GROWXC", "Earn 50% off", "Podcast " + "x" * 90, "Retarget", None]
    ads = [None, "A", " A // b", "A // b // c", "Idea // b // c // d", " // b", "Idea // x //  Video ",
           "Long " + "y" * 140, "Idea", "Other // q"]
    return dict(
        date=day(rng.randint(-3, 65)), platform=rng.choice(["Meta"] * 3 + ["Google", "Bing", "tiktok", "TikTok", None]),
        country=rng.choice(["US", "US", "AU", "UK", "CA", None]), campaign_id=rng.choice([f"c{k}", f"c{k}", None]),
        campaign=names[(k + rng.choice([0, 0, 1])) % len(names)],
        campaign_objective=rng.choice(["Traffic", "Sales", None]), ad_id=rng.choice(["a1", "a2", None]),
        ad_name=rng.choice(ads), spend=money(rng, 900), conversions=count(rng, 30), clicks=count(rng, 400),
        impressions=count(rng, 9000), cpa=rng.choice([None, 0.0, rng.random() * 90]),
    )


def share_row(rng):
    def pct():
        return rng.choice([None, Decimal(0), Decimal(rng.randint(0, 6000)) / 100, Decimal(15), Decimal(30)])

    return dict(
        date=day(rng.randint(-3, 65)), region=rng.choice(["US", "AU", "UK", "CA", None]),
        campaign=rng.choice(["Grow", "Earn " + "z" * 90, "Podcast", None]),
        campaign_type=rng.choice(["Search", None]), campaign_category=rng.choice(["Core", "Other"]),
        funnel_stage="TOF", is_brand_campaign=rng.choice([True, False, None]), clicks=count(rng, 90),
        spend=money(rng, 1500), conversions=count(rng, 20), actual_impressions=count(rng, 5000),
        market_size_impressions=rng.choice([None, 0, rng.randint(0, 900_000)]),
        search_impression_share_pct=pct(), search_top_impression_share_pct=pct(),
        search_absolute_top_impression_share_pct=pct(), budget_lost_impression_share_pct=pct(),
        rank_lost_impression_share_pct=pct(), budget_utilization_pct=pct(),
        estimated_budget_needed_for_lost_impressions=money(rng, 800),
        estimated_clicks_from_rank_improvement=count(rng, 50), wow_impression_share_change=pct(),
        market_position=rng.choice(["dominant", "lagging", "competitive", None]),
        performance_diagnosis=rng.choice(["budget limited", "rank limited", None]),
    )


def frame(spark, schema, make, seed, rows=4000):
    rng = random.Random(seed)
    data = [make(rng) for _ in range(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in data], schema)


@pytest.fixture(scope="module", params=[1])
def edges(spark, request):
    frames = {
        derived.blended_summary: frame(spark, BLENDED_SUMMARY, performance_row, request.param).cache(),
        derived.impression_share_report: frame(spark, IMPRESSION_SHARE_REPORT, share_row, request.param).cache(),
    }
    con = duckdb.connect()
    con.register("edge_performance", frames[derived.blended_summary].toArrow())
    con.register("edge_shares", frames[derived.impression_share_report].toArrow())
    yield frames, con
    for df in frames.values():
        df.unpersist()


def on_edges(sql):
    for prefix, table in ((oracles.BLENDED, "edge_performance"), (oracles.SHARES, "edge_shares")):
        sql = sql.replace(prefix.strip(), f"facts AS (SELECT * FROM {table})")
    return sql


NAMES = sorted(n for n, (source, _) in builds().items()
               if source in (derived.blended_summary, derived.impression_share_report))


@pytest.mark.parametrize("name", NAMES)
def test_equal_on_edge_rows(edges, name):
    frames, con = edges
    source, build = builds()[name]
    assert frame_difference(build(frames[source]), con, on_edges(oracle_sql()[name])) is None
