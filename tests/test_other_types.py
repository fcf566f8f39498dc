"""Facts whose measures are double, or decimal throughout, give the same reports."""

import json

import pytest
from conftest import AS_OF, day

from spendscope.operators import anomaly, campaign, creative, impression, regional, weekly

REPORTS = {
    "weekly": lambda f, i: weekly.report(f, AS_OF),
    "campaign": lambda f, i: campaign.report(f, AS_OF, ["grow"], include_creatives=True),
    "creative": lambda f, i: creative.report(f, AS_OF),
    "regional": lambda f, i: regional.report(f, AS_OF),
    "anomaly": lambda f, i: anomaly.report(f, AS_OF),
    "impression": lambda f, i: impression.report(i, AS_OF),
}
MEASURES = {"bigint", "decimal(18,2)", "decimal(9,2)"}


@pytest.fixture(scope="module")
def frames(facts, shares):
    rows = [dict(date=day(n % 28), country=("US", "AU")[n % 2], campaign_id=f"c{n % 3}", ad_id=f"a{n % 5}",
                 spend=400 + 7 * n, conversions=5 + n % 9, clicks=40 + n, impressions=900 + n) for n in range(200)]
    labels = ["dominant", "lagging", None]
    other = [dict(date=day(n % 28), region=("US", "AU")[n % 2], campaign=f"c{n % 3}", spend=400 + 7 * n,
                  market_position=labels[n % 3], rank_lost_impression_share_pct=n % 50) for n in range(200)]
    return facts(rows), shares(other)


def cast(df, to):
    return df.select([df[n].cast(to).alias(n) if t in MEASURES else df[n] for n, t in df.dtypes])


def numbers(value):
    """Same JSON with every number as float."""
    if isinstance(value, dict):
        return {k: numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [numbers(v) for v in value]
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("to", ["double", "decimal(38,9)"])
@pytest.mark.parametrize("name", REPORTS)
def test_same_report(frames, name, to):
    def parsed(f, i):
        return {r["section"]: numbers(json.loads(r["summary_data"])) for r in REPORTS[name](f, i).collect()}

    assert parsed(*[cast(df, to) for df in frames]) == parsed(*frames)
