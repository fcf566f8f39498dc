"""SQL for DuckDB, one statement per registered query.

Written from the meaning of each report, not from the Spark code: period pairs are
joins, campaign totals fan out through a join, modes are counted and ranked. Ratios
are double / double, rounding is done in decimal, and every order has a tie-break.
"""

from __future__ import annotations

# Thresholds, labels, limits, section and field names in this module are
# those of the reports and must equal them.

AS_OF = "DATE '2024-01-30'"
REPORT_PLATFORMS = ("Meta", "Google", "Bing")
COUNTRIES = ("US", "AU", "UK")

_LINES = """
lines AS (
  SELECT l.*, r.r_name, l_partkey % 24 AS k,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 60 AS INTEGER) AS off,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS price_cents,
         CAST(ROUND(l_discount * 100) AS BIGINT) AS disc_pp,
         CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
  JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
  JOIN region r ON n_regionkey = r_regionkey),
cents AS (
  SELECT *, price_cents * (CASE WHEN off <= 7 AND k % 5 = 0 THEN 7 + k % 12
                                ELSE 2 + k % 12 END) // 10000 AS spend_cents
  FROM lines)"""

_COUNTRY = """CASE r_name WHEN 'AMERICA' THEN 'US' WHEN 'ASIA' THEN 'AU' WHEN 'EUROPE' THEN 'UK'
                WHEN 'AFRICA' THEN 'CA' ELSE 'NZ' END"""
_CAMPAIGN = """(CASE k % 6 WHEN 0 THEN 'Podcast' WHEN 1 THEN 'AU Launch' WHEN 2 THEN 'Grow_Campaign'
                WHEN 3 THEN 'Earn 50%' WHEN 4 THEN 'Brand Search' ELSE 'Retarget' END)
                || ' ' || CAST(k AS VARCHAR)"""
_SPEND = "CAST(spend_cents * 0.01 AS DECIMAL(18,2))"

BLENDED = f"""{_LINES},
facts AS (
  SELECT DATE '2024-01-30' - off AS date,
    CASE k % 4 WHEN 0 THEN 'Meta' WHEN 1 THEN 'Google' WHEN 2 THEN 'Bing' ELSE 'tiktok' END AS platform,
    {_COUNTRY} AS country, 'cmp_' || CAST(k AS VARCHAR) AS campaign_id, {_CAMPAIGN} AS campaign,
    CASE WHEN k = 23 THEN NULL WHEN k % 3 = 0 THEN 'Conversions' WHEN k % 3 = 1 THEN 'Awareness'
         ELSE 'Traffic' END AS campaign_objective,
    'ad_' || CAST(k AS VARCHAR) || '_' || CAST(l_suppkey % 5 AS VARCHAR) AS ad_id,
    CASE l_suppkey % 5 WHEN 0 THEN 'Standalone creative ' || CAST(k AS VARCHAR)
      WHEN 1 THEN NULL
      WHEN 2 THEN 'Concept ' || CAST(k // 4 AS VARCHAR) || ' // v1'
      WHEN 3 THEN 'Concept ' || CAST(k // 4 AS VARCHAR) || ' // v2 // Video'
      ELSE 'Concept ' || CAST(k // 4 AS VARCHAR) || ' // v3 // Static // Creator '
           || CAST(k % 3 AS VARCHAR) END AS ad_name,
    qty * 60 AS impressions, qty * (1 + disc_pp) // 2 AS clicks, {_SPEND} AS spend,
    qty // 20 AS conversions,
    CAST({_SPEND} AS DOUBLE) / NULLIF(CAST(qty // 20 AS DOUBLE), 0) AS cpa
  FROM cents)"""

SHARES = f"""{_LINES},
facts AS (
  SELECT DATE '2024-01-30' - off AS date, {_COUNTRY} AS region, {_CAMPAIGN} AS campaign,
    CASE k % 3 WHEN 0 THEN 'Search' WHEN 1 THEN 'Shopping' ELSE 'Performance Max' END AS campaign_type,
    CASE WHEN k % 2 = 0 THEN 'Core' ELSE 'Expansion' END AS campaign_category,
    CASE WHEN k % 4 < 2 THEN 'TOF' ELSE 'BOF' END AS funnel_stage,
    CASE WHEN k % 7 = 0 THEN NULL ELSE k % 6 = 4 END AS is_brand_campaign,
    qty * (1 + disc_pp) // 2 AS clicks, {_SPEND} AS spend, qty // 20 AS conversions,
    qty * 60 AS actual_impressions, qty * 60 * (2 + disc_pp % 4) AS market_size_impressions,
    CAST(20 + disc_pp * 3 AS DECIMAL(9,2)) AS search_impression_share_pct,
    CAST(10 + disc_pp * 2 AS DECIMAL(9,2)) AS search_top_impression_share_pct,
    CAST(5 + disc_pp AS DECIMAL(9,2)) AS search_absolute_top_impression_share_pct,
    CASE WHEN l_linenumber % 7 = 0 THEN NULL
         ELSE CAST((k * 2) % 45 AS DECIMAL(9,2)) END AS budget_lost_impression_share_pct,
    CAST((k * 5) % 45 AS DECIMAL(9,2)) AS rank_lost_impression_share_pct,
    CASE WHEN k = 11 THEN NULL
         ELSE CAST(50 + (k * 7) % 50 AS DECIMAL(9,2)) END AS budget_utilization_pct,
    CAST((spend_cents * ((k * 2) % 45) // 100) * 0.01 AS DECIMAL(18,2))
      AS estimated_budget_needed_for_lost_impressions,
    qty * (1 + disc_pp) // 2 * ((k * 5) % 45) // 100 AS estimated_clicks_from_rank_improvement,
    CAST(disc_pp - 5 AS DECIMAL(9,2)) AS wow_impression_share_change,
    CASE (qty + k) % 4 WHEN 0 THEN 'dominant' WHEN 1 THEN 'competitive' WHEN 2 THEN 'lagging'
         ELSE NULL END AS market_position,
    CASE l_returnflag WHEN 'A' THEN 'budget limited' WHEN 'R' THEN 'rank limited'
         ELSE NULL END AS performance_diagnosis
  FROM cents)"""


def decimal_counts(statement: str) -> str:
    """The statement over facts with fractional conversions."""
    return statement.replace("qty // 20", "CAST(qty / 20 AS DECIMAL(18,2))").replace(
        "CAST(SUM(conversions) AS BIGINT)", "CAST(SUM(conversions) AS DOUBLE)").replace(
        "CAST(SUM(total_conversions) AS BIGINT)", "CAST(SUM(total_conversions) AS DOUBLE)")


def many_keys(statement: str) -> str:
    """The statement over facts with a campaign per part, half of all rows in one of them,
    an ad per order, free-text diagnoses and a hundredfold spend."""
    for old, new in (
        ("l_partkey % 24 AS k", "CASE WHEN l_orderkey % 2 = 0 THEN 8 ELSE l_partkey END AS k"),
        ("'_' || CAST(l_suppkey % 5 AS VARCHAR) AS ad_id", "'_' || CAST(l_orderkey AS VARCHAR) AS ad_id"),
        ("CASE l_returnflag WHEN 'A' THEN 'budget limited' WHEN 'R' THEN 'rank limited'\n         ELSE NULL END AS performance_diagnosis",
         "CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'order ' || CAST(l_orderkey % 5000 AS VARCHAR) END AS performance_diagnosis"),
        ("END) // 10000 AS spend_cents", "END) // 100 AS spend_cents"),
    ):
        statement = statement.replace(old, new)
    return statement


# ---------------------------------------------------------------- fragments


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str) -> str:
    return f"({ratio(a, b)} * 100)"


def rnd(x: str, places: int) -> str:
    return f"ROUND(CAST({x} AS DECIMAL(38,10)), {places})"


def mean(x: str) -> str:
    return ratio(f"SUM({x})", f"COUNT({x})")


def bigint(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def in_list(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})" if values else "1=0"


def cur(days: int, column: str = "date") -> str:
    return f"{column} >= {AS_OF} - {days}"


def cmp(days: int, total: int, column: str = "date") -> str:
    return f"{column} >= {AS_OF} - {total} AND {column} < {AS_OF} - {days}"


def rating(cpa: str) -> str:
    return f"""CASE WHEN {cpa} <= 25 THEN 'EXCELLENT' WHEN {cpa} <= 40 THEN 'GOOD'
        WHEN {cpa} <= 60 THEN 'ACCEPTABLE' ELSE 'NEEDS_ATTENTION' END"""


def target(platform: str = "platform") -> str:
    return f"""CAST(CASE {platform} WHEN 'Meta' THEN 50 WHEN 'Google' THEN 25 WHEN 'Bing' THEN 25
        ELSE 40 END AS DOUBLE)"""


def change(cur_: str, prev: str) -> str:
    return f"CASE WHEN {prev} > 0 THEN ({cur_} - {prev}) / {prev} END"


def pct_change(cur_: str, prev: str) -> str:
    return f"CASE WHEN {prev} > 0 THEN {rnd(f'({cur_} - {prev}) / {prev} * 100', 1)} END"


def count_if(condition: str) -> str:
    return f"COUNT(*) FILTER (WHERE {condition})"


def first(columns: str) -> str:
    return ", ".join(f"{c.strip()} NULLS FIRST" for c in columns.split(","))


def doubles(table: str, columns: str, rounded: str = "", order: str = "") -> str:
    """SELECT * with decimals as DOUBLE, and averages of doubles rounded to 6 places."""
    parts = [f"CAST({c} AS DOUBLE) AS {c}" for c in columns.split()]
    parts += [f"CAST({rnd(c, 6)} AS DOUBLE) AS {c}" for c in rounded.split()]
    replace = f" REPLACE ({', '.join(parts)})" if parts else ""
    return f"SELECT *{replace} FROM {table} {order}"


def item(columns: str, cut: dict[str, int] | None = None) -> str:
    """A struct of the columns, long names cut."""
    cut = cut or {}
    return "{" + ", ".join(
        f"'{c}': substr({c}, 1, {cut[c]})" if c in cut else f"'{c}': {c}" for c in columns.split()) + "}"


def items(table: str, columns: str, order: str = "position", cut: dict[str, int] | None = None) -> str:
    return f"(SELECT list({item(columns, cut)} ORDER BY {order}) FROM {table})"


def texts(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def section(name: str, fields: dict[str, str]) -> str:
    body = ", ".join(f"'{k}': {v}" for k, v in fields.items())
    return f"SELECT '{name}' AS section, CAST(to_json({{{body}}}) AS VARCHAR) AS summary_data"


def parts_of(name: str, fields: dict[str, str], array: str, found: str, table: str, per_row: int) -> str:
    """A section in numbered parts: ``found`` is an item of ``table``, ordered by position."""
    return section(name, {**fields, "part": "part", array: "found"}) + f"""
      FROM (SELECT 1 AS part) FULL JOIN (
        SELECT (position - 1) // {per_row} + 1 AS part, list({found} ORDER BY position) AS found
        FROM {table} GROUP BY 1) USING (part)"""


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts) + "\nORDER BY section"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select


# ---------------------------------------------------------------- weekly


def weekly(select: str, days=7, platforms=REPORT_PLATFORMS, countries=COUNTRIES) -> str:
    base = f"""
base AS (
  SELECT platform, country, campaign_objective, SUM(spend) AS total_spend,
    {bigint('SUM(conversions)')} AS total_conversions,
    {ratio('SUM(spend)', 'SUM(conversions)')} AS blended_cpa,
    COUNT(DISTINCT campaign_id) AS campaign_count
  FROM facts WHERE {cur(days)} AND {in_list('platform', platforms)}
    AND {in_list('country', countries)} AND spend > 0
  GROUP BY ALL HAVING SUM(spend) >= 500 AND SUM(conversions) >= 5)"""
    summary = f"""
platforms AS (
  SELECT platform, SUM(total_spend) AS platform_spend,
    {bigint('SUM(total_conversions)')} AS platform_conversions,
    {ratio('SUM(total_spend)', 'SUM(total_conversions)')} AS platform_cpa,
    {bigint('SUM(campaign_count)')} AS total_campaigns, {target()} AS target_cpa
  FROM base GROUP BY platform),
countries AS (
  SELECT country, SUM(total_spend) AS country_spend,
    {bigint('SUM(total_conversions)')} AS country_conversions,
    {ratio('SUM(total_spend)', 'SUM(total_conversions)')} AS country_cpa,
    COUNT(DISTINCT platform) AS active_platforms
  FROM base GROUP BY country)"""
    sections = f"""
platform_overview AS (
  SELECT ROW_NUMBER() OVER (ORDER BY platform) AS position, platform,
    {rnd('platform_spend', 2)} AS spend, platform_conversions AS conversions,
    {rnd('platform_cpa', 2)} AS cpa, target_cpa,
    {rnd('(platform_cpa - target_cpa) / target_cpa * 100', 1)} AS vs_target_pct,
    total_campaigns AS campaigns,
    CASE WHEN platform_cpa <= target_cpa * 0.8::DOUBLE THEN 'EXCELLENT'
         WHEN platform_cpa <= target_cpa THEN 'ON_TARGET'
         WHEN platform_cpa <= target_cpa * 1.2::DOUBLE THEN 'ACCEPTABLE'
         ELSE 'NEEDS_ATTENTION' END AS status
  FROM platforms),
regional_overview AS (
  SELECT ROW_NUMBER() OVER (ORDER BY country_spend DESC, country) AS position, country,
    {rnd('country_spend', 2)} AS spend, country_conversions AS conversions,
    {rnd('country_cpa', 2)} AS cpa, active_platforms,
    RANK() OVER (ORDER BY country_cpa NULLS FIRST) AS efficiency_rank
  FROM countries),
issues AS (
  SELECT ROW_NUMBER() OVER (ORDER BY total_spend DESC, {first('platform, country, campaign_objective')})
      AS position, platform || ' - ' || country AS description, {rnd('blended_cpa', 2)} AS current_cpa,
    {target()} AS target_cpa,
    {rnd(f'(blended_cpa - {target()}) / {target()} * 100', 1)} AS overspend_pct,
    {rnd('total_spend', 2)} AS financial_impact
  FROM base WHERE blended_cpa > {target()} * 1.2::DOUBLE QUALIFY position <= 5),
scalable AS (
  SELECT *, CAST(ROUND(total_spend * CAST(CASE WHEN total_spend < 500 THEN 1.0
      WHEN total_spend < 1500 THEN 0.5 ELSE 0.2 END AS DECIMAL(4,2)), 0) AS BIGINT) AS potential
  FROM base WHERE blended_cpa <= {target()} * 0.8::DOUBLE),
opportunities AS (
  SELECT ROW_NUMBER() OVER (ORDER BY potential DESC, {first('platform, country, campaign_objective')})
      AS position, platform || ' - ' || country || ' - ' || campaign_objective AS description,
    {rnd('blended_cpa', 2)} AS current_cpa, {target()} AS target_cpa,
    {rnd(f'({target()} - blended_cpa) / {target()} * 100', 1)} AS efficiency_margin,
    {rnd('total_spend', 2)} AS current_spend, potential AS additional_spend_potential
  FROM scalable QUALIFY position <= 5)"""
    return with_(BLENDED, base, summary, sections, select=select)


def distinct_campaigns(table: str, money: str, key: str, days=7) -> str:
    """A summary of weekly segments with the number of different campaigns in them."""
    return f"""
SELECT * FROM ({doubles(table, money)}) JOIN (
  SELECT b.{key}, COUNT(DISTINCT campaign_id) AS distinct_campaigns
  FROM base b JOIN facts f ON f.platform = b.platform AND f.country = b.country
    AND f.campaign_objective IS NOT DISTINCT FROM b.campaign_objective
  WHERE {cur(days)} AND spend > 0 GROUP BY b.{key}) USING ({key})"""


def weekly_report(label="7d", days=7, platforms=REPORT_PLATFORMS, countries=COUNTRIES) -> str:
    return weekly(
        union(
            section("PLATFORM_OVERVIEW", {
                "analysis_period": f"'{label} ({days} days)'",
                "platforms_analyzed": texts(platforms),
                "countries_analyzed": texts(countries),
                "platform_performance": items(
                    "platform_overview",
                    "platform spend conversions cpa target_cpa vs_target_pct campaigns status"),
            }),
            section("REGIONAL_OVERVIEW", {"regional_performance": items(
                "regional_overview", "country spend conversions cpa active_platforms efficiency_rank")}),
            section("TOP_ISSUES", {"performance_issues": items(
                "issues", "description current_cpa target_cpa overspend_pct financial_impact")}),
            section("SCALE_OPPORTUNITIES", {"opportunities": items(
                "opportunities", "description current_cpa target_cpa efficiency_margin "
                "current_spend additional_spend_potential")}),
        ),
        days, platforms, countries,
    )


# ---------------------------------------------------------------- campaign


def campaign(select: str, terms=("grow_c",), days=7, total=14) -> str:
    hit = " OR ".join(f"contains(lower(campaign), lower('{t}'))" for t in terms) or "1=0"

    def kpis(p: str) -> str:
        return f"""SUM(spend) AS spend_{p}, {bigint('SUM(conversions)')} AS conversions_{p},
    {ratio('SUM(spend)', 'SUM(conversions)')} AS cpa_{p},
    {pct('SUM(clicks)', 'SUM(impressions)')} AS ctr_{p},
    {pct('SUM(conversions)', 'SUM(clicks)')} AS cvr_{p}"""

    ctes = f"""
named AS (SELECT DISTINCT campaign FROM facts WHERE {cur(total)} AND ({hit})),
matches AS (
  SELECT DISTINCT campaign_id, campaign, platform, country FROM facts
  WHERE {cur(total)} AND ({hit}) AND spend > 0),
fanned AS (
  SELECT campaign_id, m.campaign, m.platform, m.country, f.platform AS row_platform, ad_name, date,
    spend, conversions, clicks, impressions
  FROM matches m JOIN facts f USING (campaign_id)),
current_period AS (
  SELECT campaign_id, campaign, platform, country, {kpis('current')}
  FROM fanned WHERE {cur(days)} GROUP BY ALL),
comparison_period AS (
  SELECT campaign_id, {kpis('comparison')} FROM fanned WHERE {cmp(days, total)} GROUP BY ALL),
performance AS (
  SELECT *,
    {pct_change('cpa_current', 'cpa_comparison')} AS cpa_change_pct,
    {pct_change('ctr_current', 'ctr_comparison')} AS ctr_change_pct,
    {pct_change('cvr_current', 'cvr_comparison')} AS cvr_change_pct,
    {rating('cpa_current')} AS performance_rating
  FROM current_period LEFT JOIN comparison_period USING (campaign_id)),
summary AS (
  SELECT COUNT(*) AS total_campaigns, {rnd('SUM(spend_current)', 2)} AS total_spend,
    {bigint('SUM(conversions_current)')} AS total_conversions,
    {rnd(ratio('SUM(spend_current)', 'SUM(conversions_current)'), 2)} AS blended_cpa,
    {count_if("performance_rating = 'EXCELLENT'")} AS excellent,
    {count_if("performance_rating = 'GOOD'")} AS good,
    {count_if("performance_rating = 'ACCEPTABLE'")} AS acceptable,
    {count_if("performance_rating = 'NEEDS_ATTENTION'")} AS needs_attention,
    {count_if("platform = 'Meta'")} AS meta,
    {count_if("platform = 'Google'")} AS google,
    {count_if("platform = 'tiktok'")} AS tiktok,
    {count_if("platform NOT IN ('Meta', 'Google', 'tiktok')")} AS other
  FROM performance),
problems AS (
  SELECT ROW_NUMBER() OVER (ORDER BY spend_current DESC,
      {first('campaign_id, campaign, platform, country')}) AS position,
    campaign_id, campaign, spend_current,
    campaign AS campaign_name, platform, country,
    {rnd('spend_current', 2)} AS current_spend, conversions_current AS current_conversions,
    {rnd('cpa_current', 2)} AS current_cpa,
    {rnd('COALESCE(cpa_comparison, 0)', 2)} AS comparison_cpa,
    COALESCE(cpa_change_pct, CAST(0 AS DECIMAL(38,1))) AS cpa_change_pct, performance_rating
  FROM performance
  WHERE performance_rating = 'NEEDS_ATTENTION' OR (spend_current > 1000 AND cpa_current > 50)),
top_performers AS (
  SELECT ROW_NUMBER() OVER (ORDER BY spend_current DESC,
      {first('campaign_id, campaign, platform, country')}) AS position,
    campaign AS campaign_name, platform, country,
    {rnd('spend_current', 2)} AS spend, conversions_current AS conversions,
    {rnd('cpa_current', 2)} AS cpa,
    COALESCE(cpa_change_pct, CAST(0 AS DECIMAL(38,1))) AS cpa_change_pct
  FROM performance WHERE performance_rating IN ('EXCELLENT', 'GOOD') AND spend_current >= 200
  QUALIFY position <= 10),
creative_rows AS (
  SELECT ad_name, campaign_id, SUM(spend) AS creative_spend,
    {bigint('SUM(conversions)')} AS creative_conversions,
    {ratio('SUM(spend)', 'SUM(conversions)')} AS creative_cpa
  FROM fanned WHERE {cur(days)} AND row_platform = 'Meta' AND ad_name IS NOT NULL
  GROUP BY ALL HAVING creative_spend >= 100 AND creative_conversions >= 2),
creatives AS (
  SELECT ROW_NUMBER() OVER (ORDER BY creative_cpa NULLS FIRST, ad_name, campaign_id) AS position,
    ad_name, split_part(ad_name, ' // ', 1) AS creative_concept,
    {rnd('creative_spend', 2)} AS spend, creative_conversions AS conversions,
    {rnd('creative_cpa', 2)} AS cpa
  FROM creative_rows QUALIFY position <= 10)"""
    return with_(BLENDED, ctes, select=select)


def campaign_report(terms, label="week_over_week", days=7, total=14, creatives=False, per_row=10_000) -> str:
    problem = item("campaign_name platform country current_spend current_conversions current_cpa "
                   "comparison_cpa cpa_change_pct performance_rating", {"campaign_name": 80})
    parts = [
        section("EXECUTIVE_SUMMARY", {
            "analysis_type": f"'{label}'",
            "search_terms": texts(terms),
            "period_days": str(days),
            **{c: c for c in "total_campaigns total_spend total_conversions blended_cpa".split()},
            "performance_breakdown": "{" + ", ".join(
                f"'{c}': {c}" for c in "excellent good acceptable needs_attention".split()) + "}",
            "platform_breakdown": "{" + ", ".join(
                f"'{c}': {c}" for c in "meta google tiktok other".split()) + "}",
        }) + " FROM summary",
        parts_of("PROBLEM_CAMPAIGNS", {}, "campaigns_needing_attention", problem, "problems", per_row),
        section("TOP_PERFORMERS", {"excellent_campaigns": items(
            "top_performers", "campaign_name platform country spend conversions cpa cpa_change_pct",
            cut={"campaign_name": 80})}),
    ]
    if creatives:
        parts.append(section("CREATIVE_ANALYSIS", {
            "note": "'Meta creative performance analysis included'",
            "top_creatives": items("creatives", "ad_name creative_concept spend conversions cpa",
                                   cut={"ad_name": 100, "creative_concept": 50}),
        }))
    return campaign(union(*parts), terms, days, total)


# ---------------------------------------------------------------- creative

NAME_PARTS = """
    CASE WHEN contains(ad_name, ' // ') THEN trim(split_part(ad_name, ' // ', 1))
         WHEN ad_name IS NOT NULL THEN substr(ad_name, 1, 50) ELSE 'Unknown_Concept' END AS creative_concept,
    CASE WHEN len(string_split(ad_name, ' // ')) > 2 THEN trim(split_part(ad_name, ' // ', 3)) END
      AS creative_format,
    CASE WHEN len(string_split(ad_name, ' // ')) > 3 THEN trim(split_part(ad_name, ' // ', 4)) END
      AS creative_creator"""


def creative(select: str, days=14, countries=COUNTRIES, min_spend=300, sort_by="cpa") -> str:
    order = {"cpa": "cpa NULLS FIRST", "spend": "total_spend DESC", "conversions": "total_conversions DESC"}
    ctes = f"""
named AS (SELECT *, {NAME_PARTS} FROM facts),
ads AS (
  SELECT ad_id, ad_name, country, SUM(spend) AS total_spend,
    {bigint('SUM(conversions)')} AS total_conversions, {ratio('SUM(spend)', 'SUM(conversions)')} AS cpa,
    {pct('SUM(clicks)', 'SUM(impressions)')} AS ctr, {pct('SUM(conversions)', 'SUM(clicks)')} AS cvr,
    creative_concept, creative_format, creative_creator
  FROM named WHERE {cur(days)} AND platform = 'Meta' AND {in_list('country', countries)} AND spend > 0
  GROUP BY ad_id, ad_name, country, creative_concept, creative_format, creative_creator
  HAVING SUM(spend) >= {min_spend} AND SUM(conversions) >= 2),
concepts AS (
  SELECT creative_concept, COUNT(*) AS ad_count, SUM(total_spend) AS concept_spend,
    {bigint('SUM(total_conversions)')} AS concept_conversions,
    {ratio('SUM(total_spend)', 'SUM(total_conversions)')} AS concept_cpa,
    AVG(ctr) AS avg_ctr, AVG(cvr) AS avg_cvr,
    {rating(ratio('SUM(total_spend)', 'SUM(total_conversions)'))} AS performance_tier
  FROM ads WHERE creative_concept IS NOT NULL GROUP BY creative_concept
  HAVING SUM(total_spend) >= {min_spend} * 2),
top_ads AS (
  SELECT ad_name, creative_concept AS concept, creative_format AS format,
    creative_creator AS creator, country, {rnd('total_spend', 2)} AS spend,
    total_conversions AS conversions, {rnd('cpa', 2)} AS cpa, {rnd('ctr', 2)} AS ctr,
    {rnd('cvr', 2)} AS cvr,
    ROW_NUMBER() OVER (ORDER BY ads.{order[sort_by]}, {first('ad_id, ads.ad_name, country')}) AS rank
  FROM ads QUALIFY rank <= 10),
tiers AS (
  SELECT performance_tier, COUNT(*) AS concept_count, SUM(concept_spend) AS tier_spend,
    AVG(concept_cpa) AS avg_tier_cpa FROM concepts GROUP BY performance_tier),
tier_items AS (
  SELECT performance_tier AS tier, concept_count, {rnd('tier_spend', 2)} AS total_spend,
    {rnd('avg_tier_cpa', 2)} AS avg_cpa FROM tiers),
top_concepts AS (
  SELECT ROW_NUMBER() OVER (ORDER BY concept_cpa NULLS FIRST, creative_concept) AS position,
    creative_concept AS concept, ad_count, {rnd('concept_spend', 2)} AS total_spend,
    concept_conversions AS conversions, {rnd('concept_cpa', 2)} AS cpa,
    {rnd('concepts.avg_ctr', 2)} AS avg_ctr, {rnd('concepts.avg_cvr', 2)} AS avg_cvr, performance_tier
  FROM concepts QUALIFY position <= 8)"""
    return with_(BLENDED, ctes, select=select)


def creative_overview(label, days, countries, min_spend, sort_by) -> str:
    return section("CREATIVE_OVERVIEW", {
        "analysis_period": f"'{label} ({days} days)'",
        "countries_analyzed": texts(countries),
        "min_spend_threshold": str(min_spend),
        "sort_criteria": f"'{sort_by}'",
        "total_creatives_analyzed": "(SELECT COUNT(*) FROM ads)",
        "total_concepts": "(SELECT COUNT(*) FROM concepts)",
        "performance_distribution": items(
            "tier_items", "tier concept_count total_spend avg_cpa", "tier"),
    })


def creative_report(label="14d", days=14, countries=COUNTRIES, min_spend=300, sort_by="cpa") -> str:
    return creative(
        union(
            creative_overview(label, days, countries, min_spend, sort_by),
            section("TOP_CONCEPTS", {"best_performing_concepts": items(
                "top_concepts", "concept ad_count total_spend conversions cpa avg_ctr avg_cvr "
                "performance_tier")}),
            section("TOP_INDIVIDUAL_ADS", {
                "sorting_note": f"'Sorted by {sort_by}'",
                "top_performers": items(
                    "top_ads", "ad_name concept format creator country spend conversions cpa ctr cvr rank",
                    "rank", {"ad_name": 120})}),
        ),
        days, countries, min_spend, sort_by,
    )


# ---------------------------------------------------------------- regional


def regional(select: str, platforms=("Meta", "Google"), days=14, trends=True) -> str:
    where = f"{in_list('platform', platforms)} AND spend > 0"
    if trends:
        previous = f"""spend_previous, conversions_previous, cpa_previous,
    {pct_change('cpa_current', 'cpa_previous')} AS cpa_change_pct"""
        join = "LEFT JOIN previous_period USING (platform, country, campaign_objective)"
    else:
        previous = """CAST(NULL AS DECIMAL(38,2)) AS spend_previous,
    CAST(NULL AS BIGINT) AS conversions_previous, CAST(NULL AS DOUBLE) AS cpa_previous,
    CAST(NULL AS DECIMAL(38,1)) AS cpa_change_pct"""
        join = ""
    ctes = f"""
current_period AS (
  SELECT platform, country, campaign_objective, SUM(spend) AS spend_current,
    {bigint('SUM(conversions)')} AS conversions_current,
    {ratio('SUM(spend)', 'SUM(conversions)')} AS cpa_current,
    {pct('SUM(clicks)', 'SUM(impressions)')} AS ctr_current,
    COUNT(DISTINCT campaign_id) AS campaign_count_current
  FROM facts WHERE {cur(days)} AND {where} GROUP BY 1, 2, 3),
previous_period AS (
  SELECT platform, country, campaign_objective, SUM(spend) AS spend_previous,
    {bigint('SUM(conversions)')} AS conversions_previous,
    {ratio('SUM(spend)', 'SUM(conversions)')} AS cpa_previous
  FROM facts WHERE {cmp(days, 2 * days)} AND {where} GROUP BY 1, 2, 3),
performance AS (
  SELECT platform, country, campaign_objective, spend_current, conversions_current, cpa_current,
    ctr_current, campaign_count_current, {previous}, {rating('cpa_current')} AS performance_rating
  FROM current_period {join} WHERE spend_current >= 500),
summary AS (
  SELECT country, SUM(spend_current) AS total_spend, {bigint('SUM(conversions_current)')} AS total_conversions,
    {ratio('SUM(spend_current)', 'SUM(conversions_current)')} AS blended_cpa, AVG(ctr_current) AS avg_ctr,
    {bigint('SUM(campaign_count_current)')} AS total_campaigns,
    COUNT(DISTINCT platform) AS active_platforms, {mean('cpa_change_pct')} AS avg_cpa_change,
    {count_if("performance_rating IN ('EXCELLENT', 'GOOD')")} AS strong_segments,
    {count_if("performance_rating = 'NEEDS_ATTENTION'")} AS weak_segments
  FROM performance GROUP BY country HAVING SUM(spend_current) >= 1000),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY {first('blended_cpa, country')}) AS efficiency_rank FROM summary),
matrix AS (
  SELECT platform, country, SUM(spend_current) AS platform_country_spend,
    {bigint('SUM(conversions_current)')} AS platform_country_conversions,
    {ratio('SUM(spend_current)', 'SUM(conversions_current)')} AS platform_country_cpa,
    AVG(ctr_current) AS platform_country_ctr, {mean('cpa_change_pct')} AS platform_country_change,
    COUNT(*) AS segment_count
  FROM performance GROUP BY platform, country HAVING SUM(spend_current) >= 500),
country_items AS (
  SELECT ROW_NUMBER() OVER (ORDER BY total_spend DESC, country NULLS FIRST) AS position, country,
    {rnd('ranked.total_spend', 2)} AS total_spend, total_conversions,
    {rnd('ranked.blended_cpa', 2)} AS blended_cpa, {rnd('ranked.avg_ctr', 2)} AS avg_ctr, total_campaigns,
    active_platforms, {rnd('COALESCE(avg_cpa_change, 0)', 1)} AS avg_cpa_change_pct, strong_segments,
    weak_segments, efficiency_rank FROM ranked),
matrix_items AS (
  SELECT ROW_NUMBER() OVER (ORDER BY {first('platform, platform_country_cpa, country')}) AS position,
    platform, country, {rnd('platform_country_spend', 2)} AS spend,
    platform_country_conversions AS conversions, {rnd('platform_country_cpa', 2)} AS cpa,
    {rnd('platform_country_ctr', 2)} AS ctr,
    {rnd('COALESCE(platform_country_change, 0)', 1)} AS cpa_change_pct, segment_count AS segments_analyzed
  FROM matrix)"""
    return with_(BLENDED, ctes, select=select)


def distinct_of_segments(rounded: str, days=14) -> str:
    """Countries with the number of different campaigns in their segments."""
    return f"""
SELECT s.*, d.distinct_campaigns FROM ({doubles("summary", "total_spend", rounded)}) s JOIN (
  SELECT p.country, COUNT(DISTINCT campaign_id) AS distinct_campaigns
  FROM performance p JOIN facts f ON f.platform = p.platform AND f.country IS NOT DISTINCT FROM p.country
    AND f.campaign_objective IS NOT DISTINCT FROM p.campaign_objective
  WHERE {cur(days)} AND spend > 0 GROUP BY p.country) d ON s.country IS NOT DISTINCT FROM d.country"""


def regional_insights(trends=True) -> str:
    improved = """(SELECT country FROM ranked WHERE avg_cpa_change IS NOT NULL
        ORDER BY avg_cpa_change, country LIMIT 1)""" if trends else "'Trend analysis disabled'"
    return section("REGIONAL_INSIGHTS", {"key_findings": f"""{{
      'best_performing_country': (SELECT country FROM ranked ORDER BY {first('blended_cpa, country')} LIMIT 1),
      'highest_spend_country': (SELECT country FROM ranked ORDER BY total_spend DESC, country LIMIT 1),
      'most_improved': {improved},
      'needs_attention': (SELECT list(country ORDER BY country) FROM ranked
        WHERE weak_segments >= 2 AND country IS NOT NULL),
      'total_countries_analyzed': (SELECT COUNT(*) FROM ranked)}}"""})


def regional_report(platforms=("Meta", "Google"), kind="country", label="14d", days=14, trends=True,
                    per_row=10_000) -> str:
    country_item = item(
        "country total_spend total_conversions blended_cpa avg_ctr total_campaigns "
        "active_platforms avg_cpa_change_pct strong_segments weak_segments efficiency_rank")
    matrix_item = item(
        "platform country spend conversions cpa ctr cpa_change_pct segments_analyzed")
    return regional(
        union(
            parts_of("COUNTRY_COMPARISON", {
                "analysis_type": f"'{kind}'",
                "platforms_analyzed": texts(platforms),
                "period": f"'{label} ({days} days)'",
                "trend_analysis_included": "true" if trends else "false",
            }, "country_performance", country_item,
                "country_items" if kind == "country" else "(SELECT * FROM country_items WHERE false)", per_row),
            parts_of("PLATFORM_BY_COUNTRY", {
                "analysis_note": "'Platform performance breakdown by country'",
            }, "platform_country_matrix", matrix_item,
                "(SELECT * FROM matrix_items WHERE false)" if kind == "country" else "matrix_items", per_row),
            regional_insights(trends),
        ),
        platforms, days, trends,
    )


# ---------------------------------------------------------------- anomaly

_LEVELS = {"high": (0.15, 300, 3), "medium": (0.25, 500, 5), "low": (0.5, 1000, 8)}


def anomaly(select: str, sensitivity="medium", platforms=REPORT_PLATFORMS, countries=COUNTRIES,
            impact=1000) -> str:
    t, min_spend, min_conv = _LEVELS[sensitivity]
    where = f"{in_list('platform', platforms)} AND {in_list('country', countries)} AND spend > 0"

    def period(name: str, window: str) -> str:
        return f"""
{name}_period AS (
  SELECT platform, country, campaign_objective, campaign_id, campaign, SUM(spend) AS spend_{name},
    {bigint('SUM(conversions)')} AS conversions_{name}, {ratio('SUM(spend)', 'SUM(conversions)')} AS cpa_{name},
    {pct('SUM(clicks)', 'SUM(impressions)')} AS ctr_{name},
    {pct('SUM(conversions)', 'SUM(clicks)')} AS cvr_{name}, COUNT(DISTINCT date) AS active_days_{name}
  FROM facts WHERE {window} AND {where} GROUP BY 1, 2, 3, 4, 5)"""

    def size(column: str) -> str:
        return f"ABS(COALESCE({column}, 0))"

    spend_change = change("CAST(spend_current AS DOUBLE)", "CAST(spend_comparison AS DOUBLE)")
    impact_of = f"""CASE WHEN excess_cost > 0 THEN CAST(excess_cost AS DOUBLE)
      ELSE {size('cpa_change_pct')} * CAST(spend_current AS DOUBLE) END"""
    region_impact = f"""CASE WHEN total_excess_cost > 0 THEN CAST(total_excess_cost AS DOUBLE)
      ELSE {size('regional_cpa_change')} * CAST(total_spend_current AS DOUBLE) END"""
    ctes = f"""{period('current', cur(7))},{period('comparison', cmp(7, 14))},
features AS (
  SELECT campaign_id, platform, country, c.campaign_objective, c.campaign, spend_current,
    conversions_current, cpa_current, ctr_current, cvr_current, spend_comparison,
    conversions_comparison, cpa_comparison, ctr_comparison, cvr_comparison,
    {target()} AS target_cpa,
    {change('cpa_current', 'cpa_comparison')} AS cpa_change_pct,
    {change('ctr_current', 'ctr_comparison')} AS ctr_change_pct,
    {change('cvr_current', 'cvr_comparison')} AS cvr_change_pct,
    {spend_change} AS spend_change_pct,
    CASE WHEN spend_current >= {4 * min_spend} AND conversions_current >= {3 * min_conv} THEN 'HIGH'
         WHEN spend_current >= {2 * min_spend} AND conversions_current >= {2 * min_conv} THEN 'MEDIUM'
         WHEN spend_current >= {min_spend} AND conversions_current >= {min_conv} THEN 'LOW'
         ELSE 'INSUFFICIENT' END AS confidence_level,
    CAST(CASE WHEN cpa_current > {target()}
      THEN {rnd(f'(cpa_current - {target()}) * conversions_current', 6)}
      ELSE 0 END AS DECIMAL(38,4)) AS excess_cost
  FROM current_period c LEFT JOIN comparison_period USING (campaign_id, platform, country)
  WHERE spend_current >= {impact}),
regions AS (
  SELECT *, {change('blended_cpa_current', 'blended_cpa_comparison')} AS regional_cpa_change FROM (
    SELECT platform, country, SUM(spend_current) AS total_spend_current,
      {bigint('SUM(conversions_current)')} AS total_conversions_current,
      {ratio('SUM(spend_current)', 'SUM(conversions_current)')} AS blended_cpa_current,
      SUM(spend_comparison) AS total_spend_comparison,
      {bigint('SUM(conversions_comparison)')} AS total_conversions_comparison,
      {ratio('SUM(spend_comparison)', 'SUM(conversions_comparison)')} AS blended_cpa_comparison,
      COUNT(*) AS campaign_count,
      {count_if("confidence_level = 'HIGH'")} AS high_confidence_campaigns,
      {count_if(f"{size('cpa_change_pct')} >= {t}::DOUBLE")} AS volatile_campaigns,
      SUM(excess_cost) AS total_excess_cost
    FROM features WHERE confidence_level <> 'INSUFFICIENT' GROUP BY 1, 2)),
top_campaigns AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY {impact_of} DESC, {first('''campaign_id, platform, country,
      campaign_objective, campaign, spend_comparison, conversions_comparison''')}) AS position
  FROM features WHERE confidence_level <> 'INSUFFICIENT'
    AND ({size('cpa_change_pct')} >= {t}::DOUBLE OR {size('ctr_change_pct')} >= {t}::DOUBLE
      OR {size('cvr_change_pct')} >= {t}::DOUBLE OR {size('spend_change_pct')} >= {2 * t}::DOUBLE
      OR excess_cost >= 500)
  QUALIFY position <= 15),
top_regions AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY {region_impact} DESC, {first('platform, country')}) AS position
  FROM regions WHERE total_spend_current >= {impact}
    AND ({size('regional_cpa_change')} >= {t}::DOUBLE OR volatile_campaigns >= 2
      OR total_excess_cost >= 1000)
  QUALIFY position <= 10),
campaign_items AS (
  SELECT position, campaign AS campaign_name, platform, country, campaign_objective,
    {rnd('spend_current', 2)} AS current_spend, conversions_current AS current_conversions,
    {rnd('cpa_current', 2)} AS current_cpa, target_cpa,
    {rnd('COALESCE(f.cpa_change_pct, 0) * 100', 1)} AS cpa_change_pct,
    {rnd('COALESCE(f.ctr_change_pct, 0) * 100', 1)} AS ctr_change_pct,
    {rnd('COALESCE(f.cvr_change_pct, 0) * 100', 1)} AS cvr_change_pct,
    {rnd('COALESCE(f.spend_change_pct, 0) * 100', 1)} AS spend_change_pct,
    confidence_level, {rnd('f.excess_cost', 2)} AS excess_cost,
    CASE WHEN {size('f.cpa_change_pct')} >= {t}::DOUBLE THEN 'CPA_SHIFT'
         WHEN {size('f.ctr_change_pct')} >= {t}::DOUBLE THEN 'CTR_SHIFT'
         WHEN {size('f.cvr_change_pct')} >= {t}::DOUBLE THEN 'CVR_SHIFT'
         WHEN {size('f.spend_change_pct')} >= {2 * t}::DOUBLE THEN 'SPEND_SHIFT'
         WHEN f.excess_cost >= 500 THEN 'COST_OVERRUN' ELSE 'MULTIPLE_SIGNALS' END AS anomaly_type
  FROM top_campaigns f),
region_items AS (
  SELECT position, platform, country, {rnd('r.total_spend_current', 2)} AS total_spend_current,
    total_conversions_current, {rnd('r.blended_cpa_current', 2)} AS blended_cpa_current,
    {rnd('COALESCE(r.blended_cpa_comparison, 0)', 2)} AS blended_cpa_comparison,
    {rnd('COALESCE(regional_cpa_change, 0) * 100', 1)} AS regional_cpa_change_pct,
    campaign_count, high_confidence_campaigns, volatile_campaigns,
    {rnd('r.total_excess_cost', 2)} AS total_excess_cost,
    CASE WHEN volatile_campaigns >= campaign_count * 0.5 THEN 'WIDESPREAD_VOLATILITY'
         WHEN {size('regional_cpa_change')} >= {1.5 * t}::DOUBLE THEN 'MAJOR_SHIFT'
         WHEN r.total_excess_cost >= 2000 THEN 'HIGH_COST_IMPACT' ELSE 'NOTABLE_CHANGE' END AS pattern_type
  FROM top_regions r),
summary AS (
  SELECT (SELECT COUNT(*) FROM top_campaigns) AS total_campaign_anomalies,
    (SELECT COUNT(*) FROM top_regions) AS total_regional_anomalies,
    {rnd('(SELECT SUM(excess_cost) FROM top_campaigns)', 2)} AS total_excess_cost)"""
    return with_(BLENDED, ctes, select=select)


def anomaly_report(sensitivity="medium", platforms=REPORT_PLATFORMS, countries=COUNTRIES, impact=1000) -> str:
    return anomaly(
        union(
            section("ANOMALY_SUMMARY", {
                "detection_sensitivity": f"'{sensitivity}'",
                "change_threshold_pct": str(int(_LEVELS[sensitivity][0] * 100)),
                "platforms_analyzed": texts(platforms),
                "countries_analyzed": texts(countries),
                "min_impact_threshold": str(impact),
                **{c: c for c in
                   "total_campaign_anomalies total_regional_anomalies total_excess_cost".split()},
            }) + " FROM summary",
            section("CAMPAIGN_ANOMALIES", {"significant_campaign_changes": items(
                "campaign_items", "campaign_name platform country campaign_objective current_spend "
                "current_conversions current_cpa target_cpa cpa_change_pct ctr_change_pct cvr_change_pct "
                "spend_change_pct confidence_level excess_cost anomaly_type", cut={"campaign_name": 80})}),
            section("REGIONAL_ANOMALIES", {"regional_pattern_changes": items(
                "region_items", "platform country total_spend_current total_conversions_current "
                "blended_cpa_current blended_cpa_comparison regional_cpa_change_pct campaign_count "
                "high_confidence_campaigns volatile_campaigns total_excess_cost pattern_type")}),
        ),
        sensitivity, platforms, countries, impact,
    )


# ---------------------------------------------------------------- impression share

_IMPRESSION_KEYS = "region, campaign, campaign_type, campaign_category, funnel_stage, is_brand_campaign"


def lost(budget: str, rank: str) -> str:
    return f"(COALESCE({budget}, 0) + COALESCE({rank}, 0))"


def opportunity_type(budget: str, rank: str) -> str:
    b, r = f"COALESCE({budget}, 0)", f"COALESCE({rank}, 0)"
    return f"""CASE WHEN {b} >= 30 THEN 'BUDGET_OPPORTUNITY' WHEN {r} >= 30 THEN 'RANK_OPPORTUNITY'
      WHEN {b} >= 15 THEN 'BUDGET_CONSTRAINED' WHEN {r} >= 15 THEN 'RANK_IMPROVEMENT'
      WHEN {b} + {r} >= 15 THEN 'MIXED_OPPORTUNITY' ELSE 'OPTIMIZED' END"""


def budget_status(x: str) -> str:
    return f"""CASE WHEN {x} >= 85 THEN 'CONSTRAINED' WHEN {x} <= 60 THEN 'UNDERUTILIZED'
      ELSE 'BALANCED' END"""


def score(budget: str, rank: str, market: str) -> str:
    x = f"CAST({lost(budget, rank)} AS DOUBLE)"
    return f"""CASE WHEN {x} >= 50 THEN 90 + CAST(COALESCE({market}, 0) AS DOUBLE) / 100000
      WHEN {x} >= 30 THEN 70 + {x} * 0.5::DOUBLE WHEN {x} >= 15 THEN 50 + {x} * 0.8::DOUBLE
      ELSE 20 + {x} * 1.5::DOUBLE END"""


def impression(select: str, kind="overview", days=14, regions=COUNTRIES, brand=True, min_spend=500) -> str:
    brand_filter = "1=1" if brand else "COALESCE(is_brand_campaign, FALSE) = FALSE"
    keep, order, count = {
        "overview": ("total_lost_share >= 7.5", "opportunity_score", 10),
        "budget_opportunities": (
            "weighted_budget_lost >= 15 AND budget_status IN ('CONSTRAINED', 'BALANCED')",
            "additional_budget_needed", 8),
        "rank_opportunities": (
            "weighted_rank_lost >= 15 AND opportunity_type IN ('RANK_OPPORTUNITY', 'RANK_IMPROVEMENT')",
            "potential_clicks_from_rank", 8),
        "regional_comparison": (f"total_spend >= {2 * min_spend}", "opportunity_score", 6),
    }[kind]

    def share(column: str, weight: str) -> str:
        return ratio(f"SUM({column} * {weight})", f"SUM({weight})")

    def mode(column: str) -> str:
        return f"""
{column}_counts AS (
  SELECT {_IMPRESSION_KEYS}, {column}, ROW_NUMBER() OVER (PARTITION BY {_IMPRESSION_KEYS}
      ORDER BY COUNT(*) DESC, {column} NULLS FIRST) AS rn
  FROM kept GROUP BY {_IMPRESSION_KEYS}, {column})"""

    def join(column: str, alias: str) -> str:
        on = " AND ".join(
            f"s.{k} IS NOT DISTINCT FROM {alias}.{k}" for k in _IMPRESSION_KEYS.split(", "))
        return f"JOIN {column}_counts {alias} ON {alias}.rn = 1 AND {on}"

    budget, rank = "weighted_budget_lost", "weighted_rank_lost"
    ctes = f"""
kept AS (
  SELECT * FROM facts WHERE {cur(days)} AND {in_list('region', regions)} AND {brand_filter}
    AND spend > 0 AND actual_impressions > 1000),
sums AS (
  SELECT {_IMPRESSION_KEYS}, SUM(spend) AS total_spend, {bigint('SUM(conversions)')} AS total_conversions,
    {bigint('SUM(clicks)')} AS total_clicks, {bigint('SUM(actual_impressions)')} AS total_impressions,
    {bigint('SUM(market_size_impressions)')} AS total_market_size,
    SUM(estimated_budget_needed_for_lost_impressions) AS additional_budget_needed,
    {bigint('SUM(estimated_clicks_from_rank_improvement)')} AS potential_clicks_from_rank,
    {ratio('SUM(spend)', 'SUM(conversions)')} AS blended_cpa,
    {share('search_impression_share_pct', 'actual_impressions')} AS weighted_impression_share,
    {share('search_top_impression_share_pct', 'actual_impressions')} AS weighted_top_impression_share,
    {share('search_absolute_top_impression_share_pct', 'actual_impressions')} AS weighted_absolute_top_share,
    {share('budget_lost_impression_share_pct', 'market_size_impressions')} AS weighted_budget_lost,
    {share('rank_lost_impression_share_pct', 'market_size_impressions')} AS weighted_rank_lost,
    {mean('budget_utilization_pct')} AS avg_budget_utilization,
    {mean('wow_impression_share_change')} AS avg_wow_change
  FROM kept GROUP BY ALL HAVING SUM(spend) >= {min_spend} AND SUM(clicks) >= 10),
{mode('market_position').strip()},{mode('performance_diagnosis')},
base AS (
  SELECT s.*, p.market_position AS primary_market_position, d.performance_diagnosis AS primary_diagnosis
  FROM sums s {join('market_position', 'p')} {join('performance_diagnosis', 'd')}),
classified AS (
  SELECT *, {opportunity_type(budget, rank)} AS opportunity_type,
    {budget_status('avg_budget_utilization')} AS budget_status,
    {rnd(score(budget, rank, 'total_market_size'), 1)} AS opportunity_score,
    {lost(budget, rank)} AS total_lost_share,
    CASE WHEN total_market_size > 0
      THEN {rnd(ratio('total_impressions', 'total_market_size') + ' * 100', 2)} END
      AS calculated_market_share
  FROM base),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY {order} DESC, {first(_IMPRESSION_KEYS)}) AS analysis_rank
  FROM classified WHERE {keep}),
shown AS (SELECT * FROM ranked WHERE analysis_rank <= {count}),
regions AS (
  SELECT region, COUNT(*) AS campaign_count, SUM(total_spend) AS region_spend,
    {bigint('SUM(total_conversions)')} AS region_conversions,
    {ratio('SUM(total_spend)', 'SUM(total_conversions)')} AS region_cpa,
    {ratio('SUM(weighted_impression_share * total_impressions)', 'SUM(total_impressions)')}
      AS region_impression_share,
    {ratio('SUM(weighted_budget_lost * total_market_size)', 'SUM(total_market_size)')} AS region_budget_lost,
    {ratio('SUM(weighted_rank_lost * total_market_size)', 'SUM(total_market_size)')} AS region_rank_lost,
    SUM(additional_budget_needed) AS total_additional_budget,
    {bigint('SUM(potential_clicks_from_rank)')} AS total_potential_clicks,
    {mean('opportunity_score')} AS avg_opportunity_score,
    {count_if("opportunity_type = 'OPTIMIZED'")} AS optimized_campaigns,
    {count_if("total_lost_share >= 30")} AS high_opportunity_campaigns
  FROM shown GROUP BY region),
overall AS (
  SELECT COUNT(*) AS total_campaigns_analyzed, SUM(total_spend) AS total_spend_analyzed,
    {bigint('SUM(total_conversions)')} AS total_conversions_analyzed,
    {ratio('SUM(total_spend)', 'SUM(total_conversions)')} AS overall_cpa,
    {count_if("opportunity_type = 'OPTIMIZED'")} AS optimized_campaigns,
    {count_if("total_lost_share >= 30")} AS high_opportunity_count,
    {count_if("total_lost_share >= 15")} AS actionable_opportunity_count,
    {count_if("opportunity_type = 'BUDGET_OPPORTUNITY'")} AS budget_opportunities,
    {count_if("opportunity_type = 'RANK_OPPORTUNITY'")} AS rank_opportunities,
    SUM(additional_budget_needed) AS total_budget_opportunity,
    {bigint('SUM(potential_clicks_from_rank)')} AS total_rank_opportunity,
    {mean('opportunity_score')} AS average_opportunity_score
  FROM shown),
result_items AS (
  SELECT ROW_NUMBER() OVER (ORDER BY s.opportunity_score DESC, analysis_rank) AS position,
    campaign AS campaign_name, region, campaign_type, campaign_category, funnel_stage,
    is_brand_campaign, {rnd('total_spend', 2)} AS spend, total_conversions AS conversions,
    {rnd('blended_cpa', 2)} AS cpa, {rnd('weighted_impression_share', 1)} AS impression_share_pct,
    {rnd('weighted_top_impression_share', 1)} AS top_impression_share_pct,
    {rnd('weighted_absolute_top_share', 1)} AS absolute_top_share_pct,
    {rnd('weighted_budget_lost', 1)} AS budget_lost_pct, {rnd('weighted_rank_lost', 1)} AS rank_lost_pct,
    {rnd('total_lost_share', 1)} AS total_lost_share_pct,
    {rnd('avg_budget_utilization', 1)} AS budget_utilization_pct, opportunity_type, budget_status,
    opportunity_score, primary_market_position AS market_position,
    primary_diagnosis AS performance_diagnosis,
    {rnd('s.additional_budget_needed', 2)} AS additional_budget_needed, potential_clicks_from_rank,
    {rnd('avg_wow_change', 1)} AS wow_change_pct
  FROM shown s),
region_items AS (
  SELECT ROW_NUMBER() OVER (ORDER BY region_spend DESC, region NULLS FIRST) AS position, region,
    campaign_count, {rnd('region_spend', 2)} AS total_spend, region_conversions AS total_conversions,
    {rnd('region_cpa', 2)} AS regional_cpa, {rnd('region_impression_share', 1)} AS avg_impression_share_pct,
    {rnd('region_budget_lost', 1)} AS budget_lost_pct, {rnd('region_rank_lost', 1)} AS rank_lost_pct,
    {rnd('total_additional_budget', 2)} AS total_budget_opportunity, total_potential_clicks,
    {rnd('r.avg_opportunity_score', 1)} AS avg_opportunity_score, optimized_campaigns,
    high_opportunity_campaigns FROM regions r)"""
    return with_(SHARES, ctes, select=select)


def modal_labels(keys: list[str], days=14) -> str:
    """The most frequent labels and their counts, by the keys."""
    by = ", ".join(keys)

    def counts(column: str) -> str:
        return f"""
{column}_counts AS (
  SELECT {by}, {column}, COUNT(*) AS n,
    ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY COUNT(*) DESC, {column} NULLS FIRST) AS rn
  FROM facts WHERE {cur(days)} AND spend > 0 AND actual_impressions > 1000 GROUP BY {by}, {column})"""

    on = " AND ".join(f"p.{k} IS NOT DISTINCT FROM d.{k}" for k in keys)
    return f"""{counts('market_position').strip()},{counts('performance_diagnosis')},
labels AS (
  SELECT {', '.join(f'p.{k}' for k in keys)}, p.market_position, d.performance_diagnosis, p.n AS position_rows, d.n AS diagnosis_rows
  FROM market_position_counts p JOIN performance_diagnosis_counts d ON {on} WHERE p.rn = 1 AND d.rn = 1)"""


MODAL_LABELS = """
SELECT {keys}, market_position AS primary_market_position, performance_diagnosis AS primary_diagnosis,
  position_rows AS primary_market_position_rows, diagnosis_rows AS primary_diagnosis_rows FROM labels"""


def impression_report(kind="overview", label="14d", days=14, regions=COUNTRIES, brand=True,
                      min_spend=500) -> str:
    parts = [
        section("ANALYSIS_SUMMARY", {
            "analysis_type": f"'{kind}'",
            "analysis_period": f"'{label} ({days} days)'",
            "regions_analyzed": texts(regions),
            "include_brand_campaigns": "true" if brand else "false",
            "min_spend_threshold": str(min_spend),
            "total_campaigns": "total_campaigns_analyzed",
            "total_spend": rnd("total_spend_analyzed", 2),
            "total_conversions": "total_conversions_analyzed",
            "overall_cpa": rnd("overall_cpa", 2),
            "performance_distribution": """{'optimized_campaigns': optimized_campaigns,
              'high_opportunity_campaigns': high_opportunity_count,
              'actionable_opportunities': actionable_opportunity_count}""",
            "opportunity_breakdown": """{'budget_constrained': budget_opportunities,
              'rank_improvement_needed': rank_opportunities, 'already_optimized': optimized_campaigns}""",
            "total_opportunity_value": f"""{{
              'additional_budget_needed': {rnd('total_budget_opportunity', 2)},
              'potential_clicks_from_rank': total_rank_opportunity,
              'average_opportunity_score': {rnd('average_opportunity_score', 1)}}}""",
        }) + " FROM overall",
        section(f"{kind.upper()}_RESULTS", {
            "analysis_focus": f"'{kind}'",
            "campaigns": items(
                "result_items", "campaign_name region campaign_type campaign_category funnel_stage "
                "is_brand_campaign spend conversions cpa impression_share_pct top_impression_share_pct "
                "absolute_top_share_pct budget_lost_pct rank_lost_pct total_lost_share_pct "
                "budget_utilization_pct opportunity_type budget_status opportunity_score market_position "
                "performance_diagnosis additional_budget_needed potential_clicks_from_rank wow_change_pct",
                cut={"campaign_name": 80}),
        }),
    ]
    if kind in ("overview", "regional_comparison"):
        parts.append(section("REGIONAL_INSIGHTS", {"regional_performance": items(
            "region_items", "region campaign_count total_spend total_conversions regional_cpa "
            "avg_impression_share_pct budget_lost_pct rank_lost_pct total_budget_opportunity "
            "total_potential_clicks avg_opportunity_score optimized_campaigns "
            "high_opportunity_campaigns")}))
    return impression(union(*parts), kind, days, regions, brand, min_spend)
