import random
import re
from datetime import date

import pytest
from conftest import AS_OF, day, rows_of
from pyspark.sql import functions as F

from spendscope.operators import adhoc

# The rules' words, patterns and limits, as in functions/guard.py.
TABLES = ["warehouse.ads.blended_summary", "warehouse.ads.impression_share_report"]
T = TABLES[0]

CASES = [
    (None, "NOT_A_STRING"),
    (f"SELECT * FROM {T}", "NO_LIMIT"),
    (f"SELECT * FROM {T} LIMIT x", "NO_LIMIT"),
    (f"SELECT * FROM {T} LIMIT 10", "PASSED"),
    (f"  SELECT * FROM `{T}` limit\n10 ", "PASSED"),
    (f"SELECT COUNT(*) FROM {T}", "PASSED"),
    (f"SELECT count ( x ) FROM {T}", "PASSED"),
    (f"SELECT max(spend) FROM {T}", "PASSED"),
    (f"SELECT climax(spend) FROM {T}", "NO_LIMIT"),
    (f"SELECT 1 FROM {T} LIMIT 1; DROP TABLE x", "DANGEROUS_PATTERN"),
    (f"SELECT 1 FROM {T} LIMIT 1 -- note", "DANGEROUS_PATTERN"),
    (f"SELECT 1 /* note\n */ FROM {T} LIMIT 1", "DANGEROUS_PATTERN"),
    (f"SELECT 1 /* open FROM {T} LIMIT 1", "PASSED"),
    ("exec XP_cmdshell", "DANGEROUS_PATTERN"),
    (f"delete FROM {T}", "WRITE_OPERATION"),
    (f"SELECT updated_at FROM {T} LIMIT 1", "PASSED"),
    ("SELECT * FROM Information_Schema.tables LIMIT 1", "SYSTEM_SCHEMA"),
    (f"SELECT * FROM pg_catalog, {T} LIMIT 1", "PASSED"),
    (f"SELECT pg_ FROM {T} LIMIT 1", "SYSTEM_SCHEMA"),
    (f"SELECT sys.x FROM {T} LIMIT 1", "SYSTEM_SCHEMA"),
    (f"SELECT sys. x FROM {T} LIMIT 1", "PASSED"),
    (f"SELECT * INTO OUTFILE 'x' FROM {T} LIMIT 1", "FILE_OPERATION"),
    ("SELECT * FROM a.b.c LIMIT 1", "UNAUTHORIZED_TABLE"),
    ("SELECT * FROM `warehouse`.`ads`.`blended_summary` LIMIT 1", "UNAUTHORIZED_TABLE"),
    (f"SELECT * FROM {T}_x LIMIT 1", "PASSED"),
    (f"SELECT * FROM {T} JOIN {TABLES[1]} LIMIT 1", "JOIN"),
    (f"SELECT * FROM {T}, {TABLES[1]} LIMIT 1", "PASSED"),
    (f"SELECT * FROM {T} JOIN other LIMIT 1", "PASSED"),
    ("SELECT * FROM blended_summary LIMIT 1", "NO_ALLOWED_TABLE"),
    (f"SELECT '{'x' * 9900}' FROM {T} LIMIT 1", "PASSED"),
    (f"SELECT '{'x' * 10000}' FROM {T} LIMIT 1", "TOO_LONG"),
    (f"SELECT '{chr(0x1F600) * 4990}' FROM {T} LIMIT 1", "TOO_LONG"),
    (f"SELECT '{'é' * 9900}' FROM {T} LIMIT 1" + " " * 500, "PASSED"),
    ("éDROP x", "WRITE_OPERATION"),
    (f"SELECT İNSERT FROM {T} LIMIT 1", "PASSED"),
]


def audit(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    out = adhoc.query_guard_audit(df, "q", TABLES).orderBy("id").collect()
    assert all((r["verdict"] == "PASS") == (r["rule"] == "PASSED") for r in out)
    return [r["rule"] for r in out]


def test_guard_rules(spark):
    assert audit(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def plain_rules(q):
    """The rules with Python's expressions, ASCII as in the patterns, one text at a time."""
    q = q.strip()
    flags = re.I | re.A
    verbs = r"(DROP|CREATE|ALTER|INSERT|UPDATE|DELETE|TRUNCATE)"
    names = re.findall(r"`[^`]+`\.`[^`]+`\.`[^`]+`|[\w-]+\.[\w-]+\.[\w-]+", q, re.A)
    if len(q.encode("utf-16-le")) // 2 > 10_000:
        return "TOO_LONG"
    if (re.search(r";\s*" + verbs, q, flags) or "--" in q or re.search(r"/\*.*?\*/", q, re.S)
            or re.search(r"\b(xp_cmdshell|sp_executesql)\b", q, flags)):
        return "DANGEROUS_PATTERN"
    if re.search(rf"\b{verbs}\b", q, flags):
        return "WRITE_OPERATION"
    if re.search(r"\b(INFORMATION_SCHEMA|mysql|pg_|sys\.)\b", q, flags):
        return "SYSTEM_SCHEMA"
    if re.search(r"\b(LOAD|OUTFILE|DUMPFILE|EXPORT)\b", q, flags):
        return "FILE_OPERATION"
    if any(not any(t in n for t in TABLES) for n in names):
        return "UNAUTHORIZED_TABLE"
    if re.search(r"\bJOIN\b", q, flags) and len(names) > 1:
        return "JOIN"
    if not (re.search(r"\bLIMIT\s+\d+\b", q, flags) or re.search(r"\b(SUM|AVG|MAX|MIN|COUNT)\s*\(", q, flags)):
        return "NO_LIMIT"
    return "PASSED" if any(t in q for t in TABLES) else "NO_ALLOWED_TABLE"


def test_guard_against_plain_rules_on_random_texts(spark):
    pieces = ["SELECT", "*", "FROM", T, f"`{TABLES[1]}`", "LIMIT", "10", "x", "join", "JOINED", "Update",
              "updates", "sys.", "sys", "sys.a", "pg_", "pg_x", "mysql", "load", "reload", "count", "(", ")",
              "count(*)", "max (x)", ";", "; drop", "-", "--", "/*", "*/", "a.b.c", "a.b", "`a`.`b`.`c`", ".",
              "xp_cmdshell", "export,", "é", "\n", "\t", "_limit", "limit 5", "summax(", "=delete="]
    rng = random.Random(7)
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 14)))
             for _ in range(4000)]
    expected = [plain_rules(t) for t in texts]
    assert audit(spark, texts) == expected
    assert set(expected) == {
        "DANGEROUS_PATTERN", "WRITE_OPERATION", "SYSTEM_SCHEMA", "FILE_OPERATION", "UNAUTHORIZED_TABLE",
        "JOIN", "NO_LIMIT", "PASSED", "NO_ALLOWED_TABLE"}


# ---------------------------------------------------------------- governed SQL


@pytest.fixture
def views(spark, facts, shares):
    facts([dict(spend=10, conversions=0), dict(platform="Google", spend=20, conversions=4)]) \
        .createOrReplaceTempView("blended_summary")
    shares([{}]).createOrReplaceTempView("impression_share_report")
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).createOrReplaceGlobalTempView("secret_global")
    yield
    for name in ("blended_summary", "impression_share_report", "secret"):
        spark.catalog.dropTempView(name)
    spark.catalog.dropGlobalTempView("secret_global")


def test_governed_sql_runs_a_query(spark, views):
    out = adhoc.governed_sql(
        spark,
        f"SELECT platform, SAFE_DIVIDE(SUM(spend), SUM(conversions)) AS cpa FROM `{T}` GROUP BY platform;",
        aliases={T: "blended_summary"})
    assert rows_of(out) == [("Google", 5.0), ("Meta", None)]


@pytest.mark.parametrize("query", [
    "WITH t AS (SELECT platform FROM blended_summary) SELECT * FROM t LIMIT 5",
    "WITH t AS (SELECT platform, spend FROM blended_summary) SELECT count(*) FROM t a JOIN t b ON a.platform = b.platform",
    "SELECT platform FROM Blended_Summary WHERE spend IN (SELECT spend FROM blended_summary) LIMIT 5",
    "(SELECT platform FROM blended_summary) UNION ALL SELECT region FROM impression_share_report LIMIT 5",
    "SELECT platform, row_number() OVER (PARTITION BY country ORDER BY spend) FROM blended_summary ORDER BY 1 LIMIT 3",
    "SELECT platform FROM blended_summary WHERE campaign <> 'Update 5; DROP TABLE x' LIMIT 3",
    "SELECT 'UnresolvedRelation [foo, bar]' FROM blended_summary LIMIT 3",
    "SELECT country, sum(spend) FROM blended_summary GROUP BY country HAVING sum(spend) > 0",
    "SELECT EXTRACT(year FROM date), SUBSTRING(platform, 1, 2), CASE WHEN spend > 1 THEN 1 END FROM blended_summary LIMIT 1",
])
def test_governed_sql_allows(spark, views, query):
    assert adhoc.governed_sql(spark, query).count() > 0


@pytest.mark.parametrize("query", [
    "SELECT 1",
    "DROP VIEW blended_summary",
    "EXPLAIN SELECT * FROM blended_summary",
    "SHOW TABLES",
    "FROM secret SELECT *",
    "SELECT * FROM secret",
    "SELECT * FROM `secret`, blended_summary",
    "SELECT * FROM global_temp.secret_global",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret, blended_summary",
    "SELECT (SELECT max(id) FROM secret) FROM blended_summary",
    "SELECT * FROM blended_summary WHERE EXISTS (SELECT 1 FROM secret)",
    "SELECT * FROM blended_summary, LATERAL (SELECT * FROM secret)",
    "SELECT * FROM IDENTIFIER('secret'), blended_summary",
    "SELECT * FROM parquet.`/tmp/x`, blended_summary",
    "SELECT * FROM blended_summary a, impression_share_report b",
    "SELECT * FROM blended_summary JOIN impression_share_report USING (date)",
    "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM blended_summary",
    "SELECT '\n== Analyzed Logical Plan ==\n' AS x, (SELECT max(id) FROM secret) FROM blended_summary",
    "SELECT * FROM blended_summary " + "x" * 10_000,
    "SELECT * FROM blended_summary",
    "SELECT count(*) FROM blended_summary a JOIN blended_summary b ON a.platform = b.platform",
    "SELECT count(*) FROM blended_summary a, blended_summary b",
    "WITH t AS (SELECT * FROM blended_summary) SELECT count(*) FROM t a, t b",
    "WITH t AS (SELECT * FROM blended_summary) SELECT count(*) FROM t a JOIN t b ON a.spend < b.spend",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM blended_summary LIMIT 1",
    "SELECT count(reflect('java.lang.System', 'getProperty', 'user.home')) FROM blended_summary",
    "SELECT count(*) FROM blended_summary, range(1000)",
    "SELECT 'UnresolvedRelation [blended_summary]' x LIMIT 1",
    "SELECT explode(array(1, 2)) FROM blended_summary LIMIT 1",
    "SELECT a FROM VALUES (1), (2) AS t(a) LIMIT 1",
    "SELECT TRANSFORM(platform) USING 'cat' FROM blended_summary",
])
def test_governed_sql_refuses(spark, views, query):
    with pytest.raises(adhoc.QueryRefused):
        adhoc.governed_sql(spark, query)


def test_governed_sql_results_are_whole(spark, views, facts):
    facts([dict(spend=n) for n in range(1, 4)]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10_000)))) \
        .createOrReplaceTempView("blended_summary")
    assert adhoc.governed_sql(spark, "SELECT spend FROM blended_summary LIMIT 50000").count() == 30_000


def test_aliases_leave_literals_and_longer_names_alone(spark, views):
    out = adhoc.governed_sql(
        spark, f"SELECT '{T}' AS src, `{T}_x` AS y /* {T} */ FROM (SELECT platform AS `{T}_x` FROM {T}) LIMIT 1",
        aliases={T: "blended_summary"})
    assert out.first()["src"] == T


def test_a_function_of_the_session_stays(spark, views):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION WEEK_START(day DATE) RETURNS STRING RETURN 'mine'")
    try:
        out = adhoc.governed_sql(spark, "SELECT WEEK_START(date) AS w FROM blended_summary LIMIT 1")
        assert out.first()["w"] == "mine"
    finally:
        spark.sql("DROP TEMPORARY FUNCTION WEEK_START")


# ---------------------------------------------------------------- ready-made queries


def test_weekly_platform_spend(facts):
    df = facts([dict(date=date(2024, 1, d), spend=d) for d in (6, 7, 13, 14)] + [dict(date=date(2023, 12, 31))])
    out = adhoc.weekly_platform_spend(df, date(2024, 1, 1), date(2024, 1, 14))
    assert rows_of(out, "week", "weekly_spend") == [
        (date(2023, 12, 31), 6.0), (date(2024, 1, 7), 20.0), (date(2024, 1, 14), 14.0)]


def test_opportunity_rows(shares):
    df = shares([dict(budget_lost_impression_share_pct=p, date=d, estimated_budget_needed_for_lost_impressions=n)
                 for p, d, n in ((20, day(1), 9), (21, day(1), 5), (30, day(8), 9), (22, day(7), 7))])
    out = adhoc.opportunity_rows(df, AS_OF).collect()
    assert [float(r["estimated_budget_needed_for_lost_impressions"]) for r in out] == [7.0, 5.0]


def test_platform_comparison_and_visibility(facts, shares):
    df = facts([dict(platform="A", cpa=10.0), dict(platform="A", cpa=None), dict(platform="B", cpa=4.0)])
    assert [r["platform"] for r in adhoc.platform_comparison(df, AS_OF).collect()] == ["B", "A"]
    df = shares([dict(search_impression_share_pct=p, region=r) for p, r in ((10, "US"), (20, "US"), (30, "AU"))])
    assert [(r["region"], r["avg_impression_share"]) for r in adhoc.visibility(df, AS_OF).collect()] == [
        ("AU", 30.0), ("US", 15.0)]
